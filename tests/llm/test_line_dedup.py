import random

from lotweave.llm import line_dedup as L


def brute(rows, least):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(s)
    common = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for k, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x.strip(" ") not in common]
        out.append((k, None if t is None else "\n".join(kept), s, len(lines), len(lines) - len(kept)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    pool = [f"line {k}" for k in range(60)] + ["", "  ", "  line 3  ", "ünï", "shared"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randint(1, 9))), rng.choice(["a", "b", "c", "d", "e", "f", "g", None])) for k in range(120)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "shared\n" * 3000 + "end", "b"), (5, "other", "z"), rows[3], rows[3], (None, rows[4][1], "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, code int")
    for least in (2, 5, 7):
        got = [(r.doc_id, r.text, r.source, r.n_lines, r.n_removed) for r in L.line_dedup(df, min_sites=least).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, least), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.line_dedup(df).count() == 0
