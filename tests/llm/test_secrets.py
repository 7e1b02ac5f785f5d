import hashlib
import re

from ledgerline.llm import queries, secrets

BASE = (("assign", secrets.RULES[0].pattern, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
CASES = [
    None,
    "",
    "plain text",
    f'token = "{HEX}" and AKIA{"Z9" * 8} end',
    "password: abc passwd=abcdef secret='s3cr3t-value' API_KEY:=x=yzzzz apikey  =  \"qqqqqq\"",
    "token=token:abcdef token==abcdef",
    "AKIAAKIA" + "A" * 15 + " AKIA" + "B" * 15 + " AKIA" + "C" * 16,
    "é😀ü" * 50 + f"SECRET={HEX}" + "😀" + HEX,
    ("x" * 100 + f" password={HEX}\n") * 200,
    f'token = "{HEX}" and AKIA{"Z9" * 8} end',
]


def brute(text):
    found = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), no, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "spans", 1) for i, t in enumerate(CASES)] + [(None, CASES[3], None, 2), (3, CASES[4], "v2", 3)], "doc_id long, text string, blob string, todo int")
    findings, _ = secrets.ledger_scan(docs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.spans, r.base_sha256) for r in secrets.digest(findings).collect())
    texts = [(i, t) for i, t in enumerate(CASES)] + [(-1, CASES[3]), (3, CASES[4])]
    assert got == sorted((i, brute(t), hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in texts)


def test_ledger_skips_what_it_has_seen(spark):
    old = spark.createDataFrame([(0, CASES[3]), (1, "nothing")], "doc_id long, text string")
    new = spark.createDataFrame([(0, CASES[3]), (7, CASES[4]), (8, "nothing")], "doc_id long, text string")
    _, ledger = secrets.ledger_scan(old)
    assert ledger.count() == 2 * len(secrets.RULES)
    findings, grown = secrets.ledger_scan(new, ledger)
    assert grown.count() == 3 * len(secrets.RULES)
    assert {r.doc_id: r.spans for r in secrets.digest(findings).collect()} == {0: brute(CASES[3]), 7: brute(CASES[4]), 8: ""}


def test_query_goes_through_the_ledger(spark, tmp_path):
    texts = CASES * 4 + [None, f"token={HEX}"]
    spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    early = docs.filter(secrets.F.xxhash64("doc_id") < 0).count()
    assert 0 < early < len(texts)
    got = sorted((r.doc_id or -1, r.spans) for r in queries.op2_secret_ledger(spark, str(tmp_path)).collect())
    assert got == sorted((i if i % 9 else -1, brute(t)) for i, t in enumerate(texts))


def test_empty_table(spark):
    findings, ledger = secrets.ledger_scan(spark.createDataFrame([], "doc_id long, text string"))
    assert findings.count() == 0 and ledger.count() == 0


def test_keyword_without_a_value(spark):
    texts = ["password:\nnext line", "secret: (none)", "token=", "api_key : \"'", f"passwd:\n{HEX}", "secret: (none) token=abcdef"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    findings, _ = secrets.ledger_scan(docs)
    assert {r.doc_id: r.spans for r in secrets.digest(findings).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def counts(text):
    return [sum(len(m[group]) >= least for m in re.finditer(pattern, text or "")) for _, pattern, group, least in BASE]


def test_counts_are_by_kind(spark, tmp_path):
    texts = [*CASES, f"{HEX} {HEX} {HEX}", f"AKIA{'A' * 16}", f"AKIA{'A' * 16} {HEX} token=abcdef"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_secret_ledger(spark, str(tmp_path)).collect()}
    assert {i: [r.n_assign, r.n_access, r.n_hex] for i, r in got.items()} == {i: counts(t) for i, t in enumerate(texts)}
    assert {i: r.base_sha256 for i, r in got.items()} == {i: hashlib.sha256(brute(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_time_grows_with_the_matches_of_a_text_not_their_square(spark):
    text = ("x" * 60 + f" password={HEX}\n") * 10_000
    findings, _ = secrets.ledger_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = secrets.digest(findings).first()
    assert row.spans == brute(text) and [row.n_assign, row.n_access, row.n_hex] == [10_000, 0, 10_000]


def test_case_is_that_of_ascii_letters(spark):
    texts = ["PaSsWoRd=abcdef", "paſſword=abcdef", "toKen=abcdef", "apıkey=abcdef", "token=abcKdefg"]
    findings, _ = secrets.ledger_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.n_assign for r in sorted(secrets.digest(findings).collect(), key=lambda r: r.doc_id)] == [1, 0, 0, 0, 0]
