import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from mentionforge.sources import corpora
from mentionforge.sources import files as fs

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><p>We used <rs xml:id="s1" type="software">{name}</rs> <rs xml:id="v1" type="version" corresp="#s1">1.2</rs>.</p></text></TEI>'
ANN = "T1\tApplication_Usage 8 13\tNumPy\nT2\tVersion 14 17\t1.2\nR1\tVersion_of Arg1:T2 Arg2:T1\n"
FILE = "path string, sha256 string, source string, role string, format string, record string, pmcid string, scope string"


def zipped(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return data.getvalue()


@pytest.fixture
def folder(tmp_path):
    """A folder of archives and texts, good and bad, with its manifest."""
    good = {"Pubmed_fulltext/PMC11.txt": "We used NumPy 1.2 here", "Pubmed_fulltext/PMC11.ann": ANN, "x/PMC12.training.tei.xml": "", "x/PMC13.tei.xml": TEI.format(name="R"), "a_sentences/n.tei.xml": TEI.format(name="SciPy"), "alone.txt": "no annotations", "alone2.ann": ANN, "bad.tei.xml": "<TEI>", "blank.txt": "  ", "blank.ann": "", "latin.txt": b"caf\xe9", "latin.ann": ""}
    files = {"a/one.zip": zipped(good), "b/one.zip": zipped({"PMC77.tei.xml": TEI.format(name="Q")}), "broken.zip": b"PK", "evil.zip": zipped({"../x.tei.xml": TEI.format(name="R")}), "empty.zip": zipped({}), "p.txt": "A paper.".encode(), "q.xml": TEI.format(name="Tool").encode(), "split.json": b"{}"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    sha = lambda n: hashlib.sha256(files[n]).hexdigest()
    rows = [(n, sha(n), "som", "native_archive", None, None, "PMC9" if n == "b/one.zip" else None, None) for n in files if n.endswith("zip")]
    rows += [("p.txt", sha("p.txt"), "paper", "paper_text", None, "PMC50", None, "fulltext"), ("q.xml", sha("q.xml"), "paper", "paper_text", "tei", "q", None, None), ("split.json", sha("split.json"), "som-split", "native_split", None, None, None, None), ("gone.zip", "0", "som", "native_archive", None, None, None, None)]
    return str(tmp_path), rows


def test_every_file_and_member_is_accounted_for(spark, folder):
    path, rows = folder
    manifest = spark.createDataFrame(rows, FILE)
    roles = spark.createDataFrame([("som", "PMC11", "devel"), ("som", "PMC13", "train"), ("som", "PMC13", "test")], "source string, id string, role string")
    c = corpora.build_corpus(fs.checked_files(spark, path, manifest), roles)
    ledger = {(x.path, x.member): (x.outcome, x.code, x.document_id) for x in c.ledger.collect()}
    one = {m: v for (p, m), v in ledger.items() if p == "a/one.zip"}
    assert one == {
        "Pubmed_fulltext/PMC11.txt": ("document", None, "som:Pubmed_fulltext/PMC11.txt"), "Pubmed_fulltext/PMC11.ann": ("annotations", None, None), "x/PMC12.training.tei.xml": ("failed", "MALFORMED_XML", None),
        "x/PMC13.tei.xml": ("document", None, "som:x/PMC13.tei.xml"), "a_sentences/n.tei.xml": ("document", None, "som:a_sentences/n.tei.xml"), "alone.txt": ("ignored", None, None), "alone2.ann": ("ignored", None, None),
        "bad.tei.xml": ("failed", "MALFORMED_XML", None), "blank.txt": ("failed", "EMPTY_SOURCE_TEXT", None), "blank.ann": ("annotations", None, None), "latin.txt": ("failed", "NOT_UTF8", None), "latin.ann": ("annotations", None, None),
    }
    assert {k: v[:2] for k, v in ledger.items() if k[0] != "a/one.zip"} == {
        ("b/one.zip", "PMC77.tei.xml"): ("failed", "SOURCE_ID_CONFLICT"), ("broken.zip", None): ("failed", "UNSAFE_ARCHIVE"), ("evil.zip", None): ("failed", "UNSAFE_ARCHIVE"), ("empty.zip", None): ("ignored", None),
        ("p.txt", "PMC50"): ("document", None), ("q.xml", "q"): ("document", None), ("split.json", None): ("ignored", None), ("gone.zip", None): ("failed", "MISSING_OR_CHANGED"),
    }
    docs = {x.document_id: x for x in c.documents.collect()}
    assert len(docs) == sum(v[0] == "document" for v in ledger.values()) == 5
    a = docs["som:Pubmed_fulltext/PMC11.txt"]
    assert (a.text, a.pmcid, a.native_split, a.supplied_text_scope, a.source_record_id) == ("We used NumPy 1.2 here", "PMC11", "dev", "fulltext", "PMC11")
    assert [docs[f"som:{m}"].supplied_text_scope for m in ("a_sentences/n.tei.xml", "x/PMC13.tei.xml")] == ["sentence", "unverified"]
    assert docs["som:x/PMC13.tei.xml"].native_split == "unknown" and docs["paper:q"].native_split is None
    issues = sorted((x.document_id, x.id or "", x.code) for x in c.issues.collect())
    assert issues == [("som:a_sentences/n.tei.xml", "", "NATIVE_SPLIT_MISSING"), ("som:x/PMC13.tei.xml", "", "NATIVE_SPLIT_CONFLICT")]
    found = sorted((x.document_id, x.name, [e.text for e in x.version_links]) for x in c.occurrences.collect())
    assert found == [("paper:q", "Tool", ["1.2"]), ("som:Pubmed_fulltext/PMC11.txt", "NumPy", ["1.2"]), ("som:a_sentences/n.tei.xml", "SciPy", ["1.2"]), ("som:x/PMC13.tei.xml", "R", ["1.2"])]
    assert {x.status for x in c.coverage.collect()} == {"partial"} and c.native.count() == 5


def test_a_corpus_is_written_once_and_read_as_it_was(spark, folder, tmp_path):
    path, rows = folder
    c = corpora.build_corpus(fs.checked_files(spark, path, spark.createDataFrame(rows, FILE)))
    out = str(tmp_path / "corpus")
    digests = corpora.write_corpus(c, out)
    assert corpora.write_corpus(c, out) == digests
    again = corpora.load_corpus(spark, out, c, digests)
    assert sorted(x.text for x in again.documents.collect()) == sorted(x.text for x in c.documents.collect())
    with pytest.raises(fs.Refused, match="MISSING_OR_CHANGED: ledger"):
        corpora.load_corpus(spark, out, c, digests | {"ledger": "0"})
    none = corpora.build_corpus(fs.checked_files(spark, path, spark.createDataFrame(rows[-2:], FILE)))
    with pytest.raises(fs.Refused, match="NO_SOURCE_TEXT"):
        corpora.write_corpus(none, str(tmp_path / "none"))


def test_single_files(spark):
    names = {"a/d1.txt": "We used NumPy 1.2 here", "a/d1.ann": ANN, "a/d2.txt": "x", "a/d3.ann": "", "b/d4.txt": "one", "b/d4.ann": "", "c/d4.txt": "two", "c/d4.ann": "", "a/d5.txt": "x", "a/d5.ann": "T1\tQ", "readme.md": "#"}
    files = spark.createDataFrame([(k, v.encode()) for k, v in names.items()], "path string, content binary")
    c = corpora.import_files(files, "brat")
    ledger = {x.path: (x.outcome, x.code) for x in c.ledger.collect()}
    assert ledger == {
        "a/d1.txt": ("document", None), "a/d1.ann": ("annotations", None), "a/d2.txt": ("failed", "MISSING_ANNOTATIONS"), "a/d3.ann": ("failed", "MISSING_TEXT"), "b/d4.txt": ("failed", "DUPLICATE_SOURCE_ID"), "b/d4.ann": ("annotations", None),
        "c/d4.txt": ("failed", "DUPLICATE_SOURCE_ID"), "c/d4.ann": ("annotations", None), "a/d5.txt": ("failed", "MALFORMED_BRAT"), "a/d5.ann": ("annotations", None), "readme.md": ("ignored", None),
    }
    assert [(x.document_id, x.text) for x in c.documents.collect()] == [("brat:d1", names["a/d1.txt"])]
    assert [x.name for x in c.occurrences.collect()] == ["NumPy"]
    tei = spark.createDataFrame([("d.tei.xml", TEI.format(name="R").encode()), ("e.xml", b"<TEI"), ("f.txt", b"x")], "path string, content binary")
    c = corpora.import_files(tei, "tei")
    assert sorted((x.path, x.outcome, x.code, x.document_id) for x in c.ledger.collect()) == [("d.tei.xml", "document", None, "tei:d"), ("e.xml", "failed", "MALFORMED_XML", None), ("f.txt", "ignored", None, None)]
    assert corpora.import_files(tei.where("false"), "tei").ledger.count() == 0
    with pytest.raises(ValueError, match="other"):
        corpora.import_files(tei, "other")
