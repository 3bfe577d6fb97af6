"""Valid and invalid texts of every language, and the operator."""

import pytest

from quillon.llm import syntax as S
from quillon.llm._grammars import GRAMMARS, ranked, valid

VALID = {
    "c": [
        "int f(a, b)\n    struct s *a;\n    int b;\n{\n    return a->x + b;\n}", "static inline int __attribute__((unused)) f(struct a *x, const char *fmt, ...)\n{\n  for (i = 0, j = 1; i < n; i++, j--) { x[i] = (unsigned char)j; }\n  do { g(); } while (x-- > 3);\nout:\n  return -EINVAL;\n}",
        "void f(void) {\n#ifdef A\n  if (x) {\n#else\n  if (y) {\n#endif\n    g();\n  }\n}", "/*\n<<<<<<< old\n=======\n*/\nint f(void) { char *s = \"}\" \"{\"; return s[0] == '}' ? 1 : 0; }", "#define M(x) \\\n  do { x\nint f() { list_for_each_entry(p, h, m) { q(p); } switch (a) { case 1: case B: return 1; default: break; } }",
        "  int f(int a) {\n    struct p q = { .x = 1, [2] = 3, };\n    return sizeof(struct p) * a + sizeof q;\n  }", "int a[] = {1, 2, 3};\nstruct s { int x; char *y[3]; };\nenum e { A, B = 2 };\ntypedef int (*fn)(void *, int);", "EXPORT int f(u32 x) { u32 *p = (u32 *)x; p->q.r[1] |= ~(1 << 3); if (a) b(); else if (c) d(); else e(); goto out; out: ; }",
        "unsigned long f(void)\r\n{\r\n\treturn 0x1fUL + 1.5e-3f + 'a' + L'b';\r\n}",
    ],
    "cpp": [
        "std::size_t A::b(std::vector<A>& x, const B& y) const {\n  for (const auto& z : x) { n += static_cast<int>(z.size()); }\n  auto f = [&](int a) { return a * 2; };\n  try { throw std::runtime_error(\"x\"); } catch (const std::exception& e) { return 0; } catch (...) {}\n  std::unique_ptr<A> p(new A(1, 2));\n  return std::max<int>(1, x[0]);\n}",
        "template <typename T>\nT f(T a, T b = 0) { if (auto* x = g(a)) { return *x; } return a < b ? b : a; }", "class A : public B {\npublic:\n  A() : x(1), y{2} {}\n  ~A() override;\n  int f() const { return x; }\nprivate:\n  int x, y;\n};", "namespace a { using namespace std; int f() { return nullptr == p; } }",
    ],
    "java": [
        "public final long f(Map<String, List<Integer>> m, int[] a) throws IOException {\n  for (Map.Entry<String, String> e : m.entrySet()) { x = e.getKey(); }\n  try (Reader r = open(p)) { r.read(); } catch (IOException | Error e) { throw new IllegalStateException(\"}\"); } finally { y++; }\n  List<A> l = new ArrayList<>(3);\n  int[] b = new int[] {1, 2};\n  l.forEach(z -> { g(z); });\n  Runnable q = () -> h();\n  return (long) a[0] >>> 2;\n}",
        "@Override\npublic String toString() { synchronized (this.a) { return a == null ? \"x\" : a.b().c; } }", "class A extends B implements C, D {\n  private static final int X = 1;\n  enum E { P, Q }\n  A(int x) { this.x = x; }\n}", "void f() { switch (x) { case 1: return; default: do { y(); } while (z); } Object o = new Object() { public int g() { return 1; } }; }",
    ],
    "cs": [
        "public async Task<int> F(Dictionary<string, string> a, ref int b)\n{\n  var x = $\"{a} <<<<<<< {b}\";\n  foreach (var y in a.Keys) { z += y?.Length ?? 0; }\n  using (var s = Open(@\"c:\\x\")) { s.Read(out var n); }\n  try { await G(); } catch (IOException) when (b > 1) { throw; } finally { H(); }\n  a[\"k\"] = b.ToString();\n  return a.Where(q => q.Value != null).Select(q => new { q.Key, V = 1 }).Count();\n}",
        "class A : B, IC { public int X { get; set; } = 1; public string Y => x.ToString(); [Attr] private readonly int z; }", "internal object F() { lock (this) { x = (int)y; } switch (a) { case 1: break; default: return null; } return new List<int> { 1, 2 }; }",
    ],
    "js": [
        "async function f(a, b = 1, ...c) {\n  const { x, y: [z] } = await g(a)\n  let r = /[{(]/g, t = `a ${b} {`\n  for (const k of c) { r.push(k) }\n  a.forEach((q) => {\n    h(q)\n  })\n  if (!a) return\n  else b()\n  try { i++ } catch (e) { throw new Error('}') }\n  return { x, 'k': 1, f() { return 2 } }\n}",
        "class A extends B { constructor() { super(); this.x = 1; } static y = 2; async z() { await 1; } }", "const f = (x) => ({ a: x })\nexport default f", "module.exports = function (a) { return typeof a === 'x' ? [1, , 2] : a ** 2; };",
    ],
    "py": ["def f(a, *, b=1):\n    try:\n        return [x for x in a if x]\n    except (A, B):\n        pass\n", "    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n", "async def f():\n    await g()\n", "class A:\r\n    x = 1\r\n", "'''\n=======\n'''\nx = 1"],
}
INVALID = {
    "c": ["int f(void) {\n  return 1;\n", "int f(void) {\n<<<<<<< HEAD\n  a();\n=======\n  b();\n>>>>>>> x\n}", "@@ -1,2 +1,2 @@\n int f() {\n }", "int f() { x = ; }", "int f() { g(a b); }", "def f(a):\n    return 1", "int f() { if (x { y(); } }", "some words of plain text, which end here.", "int f() { s = \"open; }", "int f() { /* open }", "void f() {\n#if A\n}", "int f() { a = 1\n b = 2; }", "int f() { … }", "}"],
    "cpp": ["int f() {", "def f(x):\n  pass", "std::vector<int> f( { }", "int f() { for (auto x : y { } }"],
    "java": ["struct a *f(struct b *c) { return c->d; }", "public int f( { }", "int f() { x = new ; }", "int f() { return 1 }", "int f(struct a *b) { }", "class A {"],
    "cs": ["public int f() throws X { }", "int F() { foreach (var x y) { } }", "int F() { return \"a; }", "#if A\nint F() { }"],
    "js": ["function f( { }", "function f() { return ; } }", "public final int f(int a) { return a; }", "let x = {a: 1", "if (a { b }", "a b c", "x = `open"],
    "py": ["def f(:\n  pass", "def f():\nreturn 1", "int f() { }", "x = (1,", "<<<<<<< a\nx = 1\n=======\nx = 2\n>>>>>>> b"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert valid(language, text)


@pytest.mark.parametrize("language, text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert not valid(language, text)


@pytest.mark.parametrize("language", list(VALID))
def test_cut_texts_are_invalid(language):
    for t in VALID[language]:
        if language != "py" and "{" in t:
            cut = t[: t.rindex("}")]
            assert not valid(language, cut), cut


def test_ranking():
    assert ranked(VALID["py"][0])[0] == "py" and ranked(VALID["java"][0])[0] == "java" and ranked(VALID["c"][0])[0] in ("c", "cpp")
    assert sorted(ranked("")) == sorted(GRAMMARS)


def test_deep_and_long_texts():
    assert valid("c", "int f() { x = " + "(" * 300 + "1" + ")" * 300 + "; }")
    assert valid("js", "function f() {" + "if (a) {" * 100 + "}" * 100 + "}")
    assert valid("c", "int f() {" + "x = y + 1;\n" * 20_000 + "}")
    assert not valid("py", "(" * 500)


def test_operator(spark):
    rows = [
        ("a", 1, "r", "c", VALID["c"][0], "x"), ("a", 2, "r", "c", VALID["py"][0], "x"), ("a", 3, "r", "c", "???", "x"), ("a", 4, "r", "c", None, "x"), ("a", 5, "r", "c", " \n", "x"), ("a", 6, "r", None, "x", "x"), ("a", 7, None, "py", VALID["py"][0], "x"), ("a", 7, None, "py", VALID["py"][0], "x"), ("a", 8, "r", "cobol", "x", "x"),
    ]
    df = spark.createDataFrame(rows, "src string, row_id long, repository string, language string, text string, problem string")
    got = S.check_syntax(df)
    assert sorted((r.row_id, r.is_valid, r.parsed_as, r.problem) for r in got.collect()) == [(1, True, "c", None), (2, False, "py", "wrong_extension"), (3, False, None, "corrupt"), (7, True, "py", None), (7, True, "py", None)]
    assert all((r.language in r.accepted) == r.is_valid and (r.parsed_as in r.accepted or not r.accepted) for r in got.collect())
    rates = {(r.repository, r.language): (r.files, r.invalid, r.invalid_share) for r in S.syntax_rates(got).collect()}
    assert rates == {("r", "c"): (3, 2, 0.666667), (None, "py"): (2, 0, 0.0)}
    assert S.check_syntax(df.limit(0)).count() == 0


def test_claimed_language(spark):
    rows = [(" .PY ", None, "py"), ("", "a/b.c", "c"), (None, "x.JAVA", "java"), ("  ", None, None), ("txt", "x.c", None), ("C P P", "x", "cpp")]
    df = spark.createDataFrame(rows, "e string, f string, want string")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in df.select("want", S.claimed(F.col("e"), F.col("f")).alias("got")).collect())


def test_every_grammar_judges_the_same_read_early_or_not(spark, data):
    """Each text of the small tables under each grammar: reading only as far as needed changes no verdict."""
    from quillon.llm import _grammars as G

    texts = [r[0] for t, c in (("primevul_raw", "func"), ("cleanvul_raw", "func_before")) for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).collect() if r[0]]
    texts += ["int f(struct a *b)\n{\n    return b->c;\n}\n", "public int f(Map<String, int[]> m) { return m.get(0)[1]; }", "const f = async (a, ...b) => { return a ?? b[0]; };", "def f(a, *b):\n    return {x: 1 for x in b}\n", 'auto s = R"x(a)b)x";', "/* ( */ int g(void) { return 0; }", "", "(", ")"]
    assert len(texts) > 20
    for t in texts:
        for lang in G.GRAMMARS:
            assert G.valid(lang, t) == G.valid(lang, t, foreign=True), (lang, t)
