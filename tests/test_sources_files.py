import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from redactum.operators import corpus
from redactum.plans import catalog
from redactum.fixtures.plan import fixture_redaction
from redactum.sources import files


def test_read_folder_formats_and_crlf(spark):
    d = tempfile.mkdtemp(prefix="redactum-test-")
    with open(os.path.join(d, "a.txt"), "w", newline="") as f:
        f.write("Jan Kowalski\r\nline two\r\n")
    with open(os.path.join(d, "b.XML"), "w") as f:
        f.write("<x>Ala</x>")
    with open(os.path.join(d, "c.xml"), "w") as f:
        f.write("<x>Ola</x>")
    with open(os.path.join(d, "skip.pdf"), "w") as f:
        f.write("no")
    got = {r.name: (r.fmt, r.text) for r in files.read_folder(spark, d).collect()}
    # the glob is case-sensitive (b.XML is not listed), the suffix test is not
    assert got == {"a.txt": ("txt", "Jan Kowalski\nline two\n"), "c.xml": ("xml", "<x>Ola</x>")}
    adm = {r.name: (r.status, r.reason) for r in files.admission(files.read_binary(spark, d)).collect()}
    assert adm["skip.pdf"] == ("rejected", "suffix")
    assert adm["a.txt"] == ("accepted", None)
    assert adm["b.XML"] == ("accepted", None)


def test_file_names_are_kept(spark):
    d = tempfile.mkdtemp(prefix="redactum-test-")
    names = {"my file.txt", "100% a+b.txt", "zażółć.xml", "a%20b.txt"}
    for n in names:
        with open(os.path.join(d, n), "w") as f:
            f.write("x")
    assert {r.name for r in files.read_folder(spark, d).collect()} == names
    assert {r.name for r in files.read_binary(spark, d).collect()} == names


def test_bad_encoding_is_refused(spark):
    x = spark.createDataFrame([("a.txt", bytearray(b"ok")), ("b.txt", bytearray(b"\xff"))], "name string, content binary")
    assert {r.name: r.reason for r in files.admission(x).collect()} == {"a.txt": None, "b.txt": "encoding"}


def test_results_written_per_run(spark):
    d = tempfile.mkdtemp(prefix="redactum-test-")
    res = catalog.q_redacted_text(spark, SF_SMALL).limit(5)
    files.write_results(res, d, "r1")
    files.write_results(res, d, "r2")
    files.write_results(res, d, "r1")
    back = spark.read.parquet(d)
    assert {r.run_id: r.n for r in back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"r1": 5, "r2": 5}


def test_bio_json_roundtrip_and_split(spark):
    r = catalog.redaction(spark, SF_SMALL)
    ex = corpus.bio_examples(corpus.bio_tags(r.marked, r.spans))
    d = tempfile.mkdtemp(prefix="redactum-test-") + "/bio"
    corpus.write_bio(ex, d)
    back = corpus.read_bio(spark, d)
    assert back.count() == ex.count()
    row = back.where(F.exists("labels", lambda x: x != "O")).first()
    assert len(row.tokens) == len(row.labels) and any(l.startswith("B-") for l in row.labels)
    sp = corpus.split_by_document(ex)
    per_doc = sp.groupBy("doc_id").agg(F.count_distinct("split").alias("k"))
    assert per_doc.where("k > 1").count() == 0


def test_golden_file_reader(spark):
    from redactum.sources import golden

    d = tempfile.mkdtemp(prefix="redactum-test-")
    with open(os.path.join(d, "court.test"), "w") as f:
        f.write('ANONYMIZE("Jan  Kowalski\n mieszka") = "J. K. mieszka" OR "J.K. mieszka"\n'
                'ANONYMIZE("W IMIENIU") = NO_CHANGE\n')
    with open(os.path.join(d, "other.txt"), "w") as f:
        f.write('ANONYMIZE("x") = NO_CHANGE')
    rows = golden.read_cases(golden.read_case_files(spark, d)).orderBy("case_no").collect()
    assert [(r.file, r.case_no, r.input, r.expected, r.no_change) for r in rows] == [
        ("court.test", 1, "Jan Kowalski mieszka", ["J. K. mieszka", "J.K. mieszka"], False),
        ("court.test", 2, "W IMIENIU", ["NO_CHANGE"], True)]


def test_golden_long_expected_text(spark):
    """An expected text of any length is read: no recursion by character, which ended the executor."""
    from redactum.sources import golden

    long = "ab " * 200_000 + "x"
    files = spark.createDataFrame([("f", f'ANONYMIZE("x") = "{long}"\nANONYMIZE("y") = "a" OR "b" OR "c"\nANONYMIZE("z") = "p" OR "q')],
                                  "file string, content string")
    rows = golden.read_cases(files).orderBy("case_no").collect()
    assert [r.expected for r in rows] == [[long], ["a", "b", "c"], ["p"]]
