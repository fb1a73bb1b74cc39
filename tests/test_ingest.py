from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.functions import text as T
from loomgraph.operators import ingest
from loomgraph.sources.config import ConfigurationFile, Settings
from loomgraph.sources.files import as_json, probe, read_directory, read_text, write_json


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_splitter_covers_the_text(text, size, overlap):
    parts = ingest.split_text(text, size, overlap)
    assert all(len(p) <= size for p in parts)
    whole = parts[0]
    for p in parts[1:]:
        assert whole.endswith(p[:overlap])
        whole += p[overlap:]
    assert whole == text


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 25), (2, "short"), (3, None), (4, "")], "doc_id int, text string")
    rows = ingest.chunk_fixed(docs, size=10, overlap=2).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.part, r.parts, r.text and len(r.text)) for r in rows] == [(1, 1, 3, 10), (1, 2, 3, 10), (1, 3, 3, 9), (2, 1, 1, 5), (3, 1, 1, None), (4, 1, 1, "")]
    labelled = ingest.labelled(ingest.chunk_fixed(docs, size=10, overlap=2), "f.txt").where("doc_id = 1 and part = 2").first()
    assert labelled.text == "[Part 2 of 3 from f.txt] " + "x" * 10
    assert ingest.chunk_by_separators(docs, size=10, overlap=2).where("doc_id = 1").count() == 3


def test_guards(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ok", None, "", "ERROR: no", " \n "])], "doc_id int, text string")
    good, bad = ingest.guarded(docs)
    assert [r.doc_id for r in good.collect()] == [0]
    assert [r.reason for r in bad.orderBy("doc_id").collect()] == ["missing", "empty", "error", "blank"]


def test_joined_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "d int, p int, text string")
    assert ingest.joined_pages(pages, "d", "p").first().text == "ab"


def test_text_functions(spark):
    assert one(spark, T.trim_all("x"), " \n a b\t") == "a b"
    assert one(spark, T.ascii_fold("x"), "Zażółć gęślą Łódź 漢!") == "Zazolc gesla Lodz !"
    assert one(spark, T.pipe_split("x"), " a | |b|") == ["a", "b"]
    assert one(spark, T.strip_pipes("x"), "||a|b|") == "a|b"
    assert one(spark, T.preview("x", 3), "abcd") == "abc..." and one(spark, T.preview("x", 3), "abc") == "abc"
    assert one(spark, T.quote_escape("x"), "it's") == "it\\'s"
    assert one(spark, T.first_parts(F.split("x", ","), 2), "a,b,c") == ["a", "b"]
    assert one(spark, T.or_default("x", T.NO_SCHEMA), "") == T.NO_SCHEMA
    assert one(spark, T.fill_prompt("{a}: {{b}}", a="x"), "v") == "v: {b}"
    assert one(spark, T.fill_prompt("{a}{b}{c}{{{a}}}", a="x", b=F.lit("}}")), "{b}{{") == "{b}{{}}{c}{{b}{{}"
    assert one(spark, T.fill_prompt("none"), None) == "none" and one(spark, T.fill_prompt("{a}", a="x"), None) == ""
    assert one(spark, T.iso_time(F.col("x").cast("timestamp_ntz")), "2024-01-02 03:04:05") == "2024-01-02T03:04:05"
    assert one(spark, T.iso_time(F.col("x").cast("timestamp_ntz")), "2024-01-02 03:04:05.000070") == "2024-01-02T03:04:05.000070"
    assert one(spark, T.utc_now() > F.lit("2024-01-01").cast("timestamp_ntz"), None) is True
    for reply, want in (("generate_cypher", "generate_cypher"), (" Generate_Cypher \n", "generate_cypher"), ("end", "end"), (None, "end"), ("do not generate", "generate_cypher")):
        assert one(spark, T.guard_decision("x"), reply) == want
    assert one(spark, T.is_blank("x"), None) is True


def test_limits(spark):
    cases = {"MATCH x": "MATCH x LIMIT 5", "MATCH x;\n": "MATCH x LIMIT 5", "m limit 3": "m limit 3", "m CONTAINS 'limit 3'": "m CONTAINS 'limit 3' LIMIT 5", "m 'limited'": "m 'limited' LIMIT 5"}
    for text, want in cases.items():
        assert one(spark, T.with_limit("x"), text) == want
    assert one(spark, T.with_limit_by_substring("x"), "m 'limited'") == "m 'limited'"


def test_sources(spark, tmp_path):
    for name, data in {"a.txt": b"hello", "b.pdf": b"%PDF", "c.docx": b"zip", "d.md": b"no", "e.txt": b"", "f.txt": b"ERROR: x", "g.PDF": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h.txt").write_text("deep")
    good, bad = read_directory(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["hello"]
    assert {r.path[-6:]: r.reason for r in bad.collect()} == {"/b.pdf": "extraction failed: no PDF that can be read", "c.docx": "no extractor for docx", "/f.txt": "error"}
    assert {r.reason for r in read_directory(spark, str(tmp_path), pdf=None)[1].where("path like '%.pdf'").collect()} == {"no extractor for pdf"}
    assert read_directory(spark, str(tmp_path), pdf=lambda b: "page").__getitem__(0).count() == 2
    assert read_text(spark, str(tmp_path / "a.txt")).first().text == "hello"
    assert probe(spark).first().test == 1
    df = spark.createDataFrame([("ą", None)], "a string, b string")
    assert as_json(df).first().json == '{"a":"ą","b":null}'
    write_json(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"ą","b":null}'


def a_pdf(*streams):
    """A file of content streams, every second one deflated."""
    import zlib

    out = [b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"]
    for i, s in enumerate(streams):
        body = zlib.compress(s) if i % 2 else s
        out.append(b"%d 0 obj\n<< /Length %d%s /Resources << /Font << >> >> >>\nstream\n" % (i + 3, len(body), b" /Filter /FlateDecode" * (i % 2)) + body + b"\nendstream\nendobj\n")
    return b"".join(out) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def test_pdf_text(spark, tmp_path):
    import pytest

    from loomgraph.sources.pdf import pdf_text

    one = b"q BT /F1 12 Tf 72 700 Td (Hello \\(big\\) ) Tj [(wor) -20 (ld)] TJ 0 -14 Td (next (inner) line) Tj ET Q"
    two = b"BT <4865 6C6C6F> Tj (caf\\351) ' T* (a\\\nb) Tj ET"
    text = "Hello (big) world\nnext (inner) line" + "Hello\ncafé\nab"
    assert pdf_text(a_pdf(one, two)) == text
    for bad in (b"", b"%PD", a_pdf(b"q Q"), a_pdf(one) + b"/Encrypt", b"%PDF-1.4 << >> stream\n" + b"(" * 100_000):
        with pytest.raises(ValueError):
            pdf_text(bad)
    (tmp_path / "a.pdf").write_bytes(a_pdf(one, two))
    good, bad = read_directory(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == [text] and bad.count() == 0


def test_settings(tmp_path):
    import pytest

    (tmp_path / "s.yaml").write_text("# limits\nmax_results: 7\n\nchunk_size: 100  # characters\nchunk_overlap: 5\n")
    assert Settings.load(str(tmp_path / "s.yaml")) == Settings(max_results=7, chunk_size=100, chunk_overlap=5)
    (tmp_path / "s.yaml").write_text("max_results: many")
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "s.yaml"))
    for size, overlap in ((10, 10), (10, 12), (10, -1)):
        with pytest.raises(ValueError):
            ingest.split_text("x" * 30, size, overlap)

    assert Settings.of({"max_results": 7}).max_results == 7
    with pytest.raises(ValueError):
        Settings.of({"nope": 1})
    with pytest.raises(ValueError):
        Settings(chunk_overlap=30_000)


SECTIONS = """
rag: {max_results: 7, enable_debug: false}
data_pipeline:
  max_chunk_size: 100
  chunk_overlap: 5
llm:
  fast: {name: small, temperature: 0.1}
observability:
  langfuse: {host: "${HOST}"}
prompts:
  search: |
    Answer {user_question}
"""


def test_settings_in_sections(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    monkeypatch.setenv("HOST", "elsewhere")
    path = tmp_path / "all.yaml"
    with pytest.raises(FileNotFoundError):
        ConfigurationFile(str(path)).get()
    path.write_text(SECTIONS)
    file = ConfigurationFile(str(path))
    got = file.get()
    assert got.settings == Settings(max_results=7, chunk_size=100, chunk_overlap=5)
    assert got.prompts == {"search": "Answer {user_question}\n"} and got.models["fast"]["name"] == "small"
    assert got.sections["observability"]["langfuse"]["host"] == "${HOST}"  # as written
    path.write_text("rag: {max_results: 9}\n")
    assert file.get() is got
    assert file.reload().settings.max_results == 9 and file.get().prompts == {}
    for bad in ("rag: [", "just text", "rag: 5", "rag: {max_results: many}", "rag: {max_results: true}", "rag: {max_results: 0}", "prompts: {a: 1}", "llm: {a: {temperature: 1}}"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            file.reload()
        assert file.get().settings.max_results == 9, bad
    path.write_text("")
    with pytest.raises(ValueError):
        file.reload()


class Mapped:
    """Stands for documents whose only partition is these batches; gives what the function of mapInArrow gives."""

    def __init__(self, *batches):
        self.batches, self.schema = batches, StructType().add("doc_id", "long").add("text", "string")

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


@pytest.mark.parametrize("chunk", [ingest.chunk_by_separators, ingest.chunk_recursively])
def test_parts_go_out_in_slices_of_a_batch(chunk):
    texts = [None, "", *("some words " * (500 * i) for i in range(60))]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = chunk(Mapped(whole, whole.slice(0, 0)), size=1000, overlap=100)
    assert sum(b.nbytes for b in out) > 9_000_000 > 4 * max(b.nbytes for b in out)  # not all parts of the batch at once
    each = [r for i in range(len(texts)) for b in chunk(Mapped(whole.slice(i, 1)), size=1000, overlap=100) for r in b.to_pylist()]
    assert [r for b in out for r in b.to_pylist()] == each
