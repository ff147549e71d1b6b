"""Personal data, token alignment and conversation repair against plain versions."""

import itertools
import random
import time

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from conftest import TESTDATA
from reviewlake.llm import align, personal, repair
from test_llm_operators import TABLES, comparable, documents, odd  # noqa: F401 - fixture

PERSONAL = [
    "mail a.b+c@x-y.example.org, a@b.c@d.e ._%x@y.z @@ a@ @b.c q@r..s t@u.v.w_x@z.q", "1.2.3.4.5.6.7.8 300.1.1.1 255.255.255.255 0001.2.3.4 1.2.3 999.1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111 1111 1111 11111 378282246310005 card 378282246310005 3782 822463 10005 amex",
    "+1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 +49 30 1234567890123456 + 1 +1.23.45.67.89. tel +4930123456",
    "IBAN DE89 3704 0044 0532 0130 00 AND MORE, GB82WEST12345698765432 GB82 WEST 1234 5698 7654 33, xGB82WEST12345698765432 test NL91ABNA0417164300 ZZ891234567890123456",
    "ssn 123-45-6789 123-45-6789 far away from any of the words that would make it one, so many of them; 000-12-3456 ssn 666-12-3456 1123-45-6789 ssn, SSN:078-05-1120",
    "born 12.05.1980 and 1980-05-12; geboren: 31/12/1999, version 1.2.2003, dob 13/13/1990 dob 99.01.1990 2024-01-01T00 birthday 2024-01-01",
    "amex 378282246310005, order 371449635398431, 378282246310006", "é card ü 4111111111111111 € Visa 5500005555555559 dummy", "", None, "+", "@", "1", "\x00 a@b.c \x00", "123 456 7890123 456 7-8-9-0-1-2-3-4-5-6-7-8-9-0", "tokens" * 30000 + "@x.y",
]


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        try:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if folder == TESTDATA else '/*.parquet'}'")
        except duckdb.IOException:
            pass
    df, rel = queries()[name](spark, folder), con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = [tuple(r) for r in df.collect()]
    assert comparable(rows, df.columns) == comparable(rel.fetchall(), rel.columns)
    return rows


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("people"))
    rows = [*enumerate(PERSONAL), (3, PERSONAL[3]), (None, "a@b.c")]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("folder", ["people", "odd", TESTDATA])
def test_personal(spark, odd, people, folder):  # noqa: F811
    rows = same_as_sql(spark, "op11_personal", {"people": people, "odd": odd}.get(folder, folder))
    if folder == "people":
        kinds = {x.split(":")[0] for r in rows for x in r[6].split(",") if x}
        assert kinds == {k.kind for k in personal.BASE + personal.MORE}


def test_personal_spans_and_redaction(spark):
    text = "SSN 123-45-6789, call +1 (743) 555-3824 or é@x a.b@c.de; GB82 WEST 1234 5698 7654 32"
    row = personal.find_personal(spark.createDataFrame([(1, text)], "doc_id int, text string"), redact=True).first()
    assert [(s.kind, text[s.start:s.end]) for s in row.spans] == [
        ("email", "a.b@c.de"), ("phone", "+1 (743) 555-3824"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert row.redacted == "SSN [ssn], call [phone] or é@x [email]; [iban]"
    find = personal.Finder(personal.BASE + personal.MORE)
    assert not [s for s in find("the code 123-45-6789") if s[0] > 3]  # no word near it
    low, high = (find(x)[0][3] for x in ("example a@b.c", "contact a@b.c"))
    assert low < find("so a@b.c")[0][3] < high


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1 ", "a@", "1 ", "AA11 ", "a.b-"])
def test_personal_is_linear_in_long_texts(piece):
    find, started = personal.Finder(personal.BASE + personal.MORE), time.time()
    find(piece * 300_000)
    assert time.time() - started < 20


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    with open(f"{align.FOLDER}/{align.FILE_A}") as f:
        file = f.read()
    a = Tokenizer.from_str(file)
    a.encode_special_tokens = True
    return file, a, align.byte_vocabulary(file), sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.FILE_B}")


STRANGE = ["a  b", " a", "<|endoftext|> <s>x</s> <unk> <0x41>", "▁x", "é́ ﬁ ™ ﷽ 漢字 🙂", "tab\tx\r\n\n  ", "x" * 3000, "a" + " " * 5000 + "b", "\x00", "a"]


def strange(spark, folder):
    rows = [*enumerate(STRANGE), (0, STRANGE[0]), (100, None), (101, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"keys": F.lit(1), "_row": F.lit(2)}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("folder", ["odd", "strange", TESTDATA])
def test_alignment(spark, odd, tmp_path, tokenizers, folder):  # noqa: F811
    folder = odd if folder == "odd" else strange(spark, str(tmp_path)) if folder == "strange" else folder
    want = brute.alignment(documents(spark, folder), *tokenizers[1:])
    rows = queries()["op12_align"](spark, folder).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == want and len(rows) == len(documents(spark, folder))


@pytest.mark.parametrize("most", [0, 20])
def test_alignment_beyond_the_broadcast(spark, tokenizers, most):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = align.align_corpus(docs, align.load(spark), most)
    got = {r.doc_id: (r.n_best, r.count_sum) for r in rows.collect()}
    assert got == {k: v[4:6] for k, v in brute.alignment([(r.doc_id, r.text) for r in docs.collect()], *tokenizers[1:]).items()}


def test_alignment_libraries_agree(tokenizers):
    """The proof holds for the file, fails for one with an entry that its rules do not reach, and both libraries agree."""
    import json

    file, a, _, _ = tokenizers
    assert align.ranks_agree(file)
    broken = json.loads(file)
    broken["model"]["vocab"]["qqqqqq"] = 60000
    assert not align.ranks_agree(json.dumps(broken))
    with open(f"{align.FOLDER}/{align.FILE_B}", "rb") as f:
        model = f.read()
    fast, slow = align.Pair(file, model, True), align.Pair(file, model, False)
    texts = [x for x in STRANGE if x] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{TESTDATA}/documents.parquet' WHERE text <> ''").fetchall()]
    plain = lambda pair: [(a.tolist(), b.tolist()) for a, b in pair.encode(texts)]
    assert plain(fast) == plain(slow)


def test_alignment_groups(spark):
    row = align.encoded(spark.createDataFrame([(1, "Hello world")], "doc_id int, text string"), align.load(spark), groups=True).first()
    assert row.n_groups == len(row.groups.split(";")) and row.groups_sha256 == brute.sha(row.groups) and sum(row.times) == row.n_links


TURNS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Also."), (2, None, None, None), (None, 0, "assistant", "x"), (None, 3, "user", "y."),
    (3, 0, "as\nsistant", "<|"), (4, 0, "assistant", None), (5, 0, "system", "S."), (5, 1, "user", " \t"), (5, 2, "user", "q?"), (5, 9, "assistant", "a \n"), (6, 0, "", "z."), (6, 1, "tool", "z."),
    (7, None, "user", "b"), (7, 2, "user", "a."), (7, 2, "user", "a."), (7, 2, "assistant", "ok!")]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    folder, draw = str(tmp_path_factory.mktemp("turns")), random.Random(5)
    more = [(100 + n // 40, n % 40, draw.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), draw.choice(["", "Same.", f"Text {n}.", f"Cut {n}", "ü!  "])) for n in range(4000)]
    hot = [(7777, n, "user" if n % 500 else "assistant", f"t{n}." if n % 7 else "again.") for n in range(6000)]
    spark.createDataFrame(TURNS + more + hot, "conv_id bigint, turn bigint, role string, text string").withColumns({"dropped_": F.lit(1), "head": F.lit("h"), "audit": F.lit("K")}
                          ).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("folder", ["turns", "odd", TESTDATA])
def test_repair(spark, odd, turns, folder):  # noqa: F811
    folder = {"turns": turns, "odd": odd}.get(folder, folder)
    rows = same_as_sql(spark, "op13_repair", folder)
    assert len(rows) == spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id").distinct().count()


def test_repaired_rows_make_the_digest(spark, turns):
    rows = repair.damage(spark.read.parquet(f"{turns}/conversations.parquet"))
    mended = repair.repaired_rows(rows).collect()
    assert len({(r.conv_id, r.place) for r in mended}) == len(mended)
    lines = {}
    for r in sorted(mended, key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in repair.repair_report(rows).collect():
        mine = lines.get(r.conv_id, [])
        assert r.repaired_sha256 == brute.sha("\n".join(f"{a}:{b}" for a, b in mine))
        initials = "".join(a[0] for a, _ in mine)
        assert brute.re.fullmatch("(s?(ua)+)?", initials)


def test_cheapest_edits():
    """Every sequence of up to three symbols, and random longer ones, against all edit sequences."""
    meaning = lambda s: ("s", True, 0) if s == 0 else (repair.INITIALS[(s - 1) // 2], False, (s - 1) % 2)
    draw = random.Random(1)
    short = [x for n in range(4) for x in itertools.product(range(9), repeat=n)]
    for symbols in draw.sample(short, 250) + [tuple(draw.choices(range(9), k=4)) for _ in range(40)]:
        assert repair.cheapest(bytes(symbols)) == brute.cheapest_edits([meaning(s) for s in symbols]), symbols


def test_long_runs():
    """Runs beyond a piece, against the same rows taken one by one."""
    for symbols in (b"\x03" * 1000, b"\x05" * 777 + b"\x04" * 1001 + b"\x00" * 333, b"\x07" * 129, b"\x01\x03" + b"\x05\x03" * 500):
        cost, audit = repair.cheapest(symbols)
        behind = repair.times(repair.INSERTED, repair.DONE)
        for s in reversed(symbols):
            behind = repair.times(repair.power(s, 0), behind)
        assert cost == behind[0] and len(audit.replace("I", "")) == len(symbols)
    started = time.time()
    repair.cheapest(b"\x03\x05" * 100_000 + b"\x03" * 200_000)
    assert time.time() - started < 60
