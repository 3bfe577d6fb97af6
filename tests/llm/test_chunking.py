import random
import re

from quillon.llm import chunking as C


def code(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(f"int f{rng.randint(0, 999)}(int a)\n{{\n" + "".join(f"    x{rng.randint(0, 99)} = y + {rng.randint(0, 9999)};\n" for _ in range(rng.randint(2, 30))) + "}\n\n")
    return "".join(out)


def whole(parts, text, overlap=200, limit=6000):
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(e - b + (overlap if i else 0) <= limit for i, (b, e, _) in enumerate(parts))


def test_pieces_of_every_kind_of_text():
    rng = random.Random(1)
    texts = [code(rng, 40_000), "x" * 30_000, "word " * 5000, "a\r\nb\r" * 4000, "𝒳é\n" * 5000, "\n" * 20_000, "l" * 5900 + "\n" + "m" * 5900 + "\n", ("z" * 3900 + "\r\n") * 9]
    for t in texts:
        parts, longest = C.cut_text(t)
        whole(parts, t)
        assert longest == max(map(len, re.split(r"\r\n|\n|\r", t)))
        assert not any(t[e - 1] == "\r" and t[e : e + 1] == "\n" for _, e, _ in parts)


def test_lines_are_kept_where_they_fit():
    rng = random.Random(2)
    for _ in range(30):
        t = "".join("k" * rng.randint(0, 5700) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(12))
        if len(t) > 6000:
            parts, _ = C.cut_text(t)
            assert all(k != C.INSIDE for _, _, k in parts[:-1])


def test_a_line_is_cut_only_if_it_is_longer_than_a_piece():
    """Lines of nearly a piece's size, behind others of any size, stay whole in some piece; pieces share 200 characters wherever they are cut."""
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join("k" * rng.choice([rng.randint(0, 80), rng.randint(5500, 5820), rng.randint(5780, 6000), rng.randint(5990, 6010)]) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(rng.randint(1, 8)))
        if len(t) <= 6000:
            continue
        parts, longest = C.cut_text(t)
        pieces = [(b - (200 if i else 0), e) for i, (b, e, _) in enumerate(parts)]
        assert all(0 <= b < e <= b + 6000 for b, e in pieces) and all(x[1] - y[0] == 200 and x[1] < y[1] for x, y in zip(pieces, pieces[1:], strict=False))
        assert any(k == C.INSIDE for *_, k in parts) == (longest > 6000)
        if longest <= 6000:
            lines, p = [], 0
            for m in C.LINE_END.finditer(t):
                lines.append((p, m.start()))
                p = m.end()
            assert all(any(b <= x and y <= e for b, e in pieces) for x, y in lines)


def test_an_edit_alters_only_its_neighbourhood():
    rng = random.Random(3)
    t = code(rng, 200_000)
    at = t.index("\n", 100_000) + 1
    u = t[:at] + "    inserted = 1;\n" * 5 + t[at:]
    own = lambda x: [x[b:e] for b, e, _ in C.cut_text(x)[0]]
    a, b = own(t), own(u)
    assert len(set(a) - set(b)) <= 4 and a[:5] == b[:5] and a[-5:] == b[-5:]


def test_function_ends_are_preferred():
    parts, _ = C.cut_text(code(random.Random(4), 60_000))
    kinds = [k for *_, k in parts[:-1]]
    assert kinds.count(C.FUNCTION) >= 0.6 * len(kinds)


def test_operator(spark):
    t = code(random.Random(5), 20_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, "x" * 6000, "a"), (4, "x" * 6001, "a"), (5, t, "a"), (5, t, "a")]
    got = C.chunk(spark.createDataFrame(rows, "row_id long, text string, piece string")).collect()
    assert {r.row_id for r in got} == {4, 5}
    five = sorted((r for r in got if r.row_id == 5), key=lambda r: (r.piece, r.char_begin))[::2]
    assert "".join(r.text[r.own_begin - r.char_begin :] for r in five) == t
    assert all(a.text[-200:] == b.text[:200] for a, b in zip(five, five[1:], strict=False))
    assert C.chunk(spark.createDataFrame([], "row_id long, text string")).count() == 0
