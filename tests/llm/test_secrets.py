import random
import re

from lotweave.llm import secrets as S

KEY = "AKIA" + "ABCD2345EFGH6789"


def brute(text, scope=200):
    """All spans in plain Python: strong ones, and weak ones by comparing all pairs."""
    text = text or ""
    out = []
    rules = [("assign", S.ASSIGN, lambda m: len(m[2]) >= 8), ("access", S.ACCESS, lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    rules += [("ident", S.IDENT, lambda m: True), ("blob", S.BLOB, lambda m: all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))), ("endpoint", S.ENDPOINT, lambda m: True)]
    for rank, (kind, p, ok) in enumerate(rules):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text, re.A) if ok(m)]
    near = lambda s, role: any(S.ROLE[k] == role and abs(a - s) <= scope for a, _, _, k in out)
    keep = {"ident": lambda s: near(s, "secret"), "blob": lambda s: near(s, "ident"), "endpoint": lambda s: near(s, "secret") and near(s, "ident")}
    return [f"{k}:{a}:{e}" for a, r, e, k in sorted(out) if r < 3 or keep[k](a)]


CASES = [
    None,
    "",
    "token=token:abcdefghij password = password=abcdefgh12",
    f"x {KEY} blob Zz09Zz09Zz09Zz09Zz09Zz09 https://api.example.com/v1",
    "Zz09Zz09Zz09Zz09Zz09Zz09 alone",
    "https://api.example.com/v1 alone 10.0.0.1",
    "user_name: bob" + " " * 150 + "PASSWD='hunter2hunter2'" + " é" * 60 + "10.1.2.3:80",
    "é😀 api_key=0123456789abcdef0123456789abcdef " * 150,
]


def test_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = [KEY, "user=", "login: ann", "secret=abcdefgh", "Zz09Zz09Zz09Zz09Zz09Zz09", "10.0.0.7", "http://h/x", "é", "word " * 20, "\n", "f" * 40, "token:short"]
    texts = CASES + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += texts[3:5]
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], "doc_id long, text string, base string, start int")
    got = {r.doc_id: r.s for r in S.find_secrets(df).withColumn("s", S.written("spans")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == ",".join(brute(t)), t


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, CASES[3]), (1, CASES[3]), (1, "nothing"), (None, CASES[3])], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.s) for r in S.find_secrets(df).withColumn("s", S.written("spans")).collect())
    want = ",".join(brute(CASES[3]))
    assert rows == [(0, want), (1, ""), (1, want), (1, want)]
    assert S.find_secrets(df.limit(0)).count() == 0
