from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators import segments


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_normal_forms(spark):
    raw = "line1\r\nline2\t tab x\n\n\n\ny"
    assert one(spark, raw, t.normalize_v1) == "line1\nline2 tab x\n\ny"
    assert one(spark, "a\n\nb\n\n\nc\r\r\n\nd", t.normalize_v1) == "a\nb\n\nc\n\n\nd"
    assert one(spark, "a\n\nb", t.normalize_v2) == "a\n\nb"
    assert one(spark, None, t.normalize_v1) is None


def test_repository_keys(spark):
    rows = [
        ("git@github.com:a/b.git", "github.com/a/b"), ("https://www.GitHub.com/A/B/tree/main", "github.com/a/b"), ("github.com/a", None),
        ("git+https://gitlab.com/g/sub/p/-/issues", "gitlab.com/g/sub/p"), ("https://sourceforge.net/projects/X/files", "sourceforge.net/x"),
        ("https://sourceforge.net/x", None), ("https://example.org/a/b", None), ("", None), ("https://user@bitbucket.org:443/a/b%2Dc", "bitbucket.org/a/b-c"),
    ]
    df = spark.createDataFrame(rows, "url string, want string")
    for r in df.select("url", "want", t.repo_key(F.col("url")).alias("got")).collect():
        assert r.got == r.want, r


def test_package_urls(spark):
    rows = [
        ("https://pypi.org/project/Scikit_Learn/", ("pypi", "scikit-learn")), ("https://cran.r-project.org/package=Glmnet", ("cran", "glmnet")),
        ("https://bioconductor.org/packages/DESeq2", ("bioconductor", "deseq2")), ("https://bioconductor.org/packages/release/bioc/html/limma.html", ("bioconductor", "limma")),
        ("https://bioconductor.org/packages/3.18/", None), ("https://example.org/x", None),
    ]
    for url, want in rows:
        got = one(spark, url, t.url_package)
        assert (tuple(got) if got else None) == want, url


def test_sentences():
    assert len(segments.sentence_spans("We used Python 3.10 and NumPy 1.24 and R 4.3")) == 1
    assert len(segments.sentence_spans("We used R and e.g. SAS. Next sentence.")) == 2
    assert segments.sentence_spans("") == [(0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. !?\n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_chunks_cover_every_character(text, budget, overlap):
    covered = set()
    for a, b, _ in segments.chunk_spans(text, budget, overlap):
        covered.update(range(a, b))
    gaps = "".join(text[i] for i in range(len(text)) if i not in covered)
    assert gaps.strip() == ""


def test_sections_and_place(spark):
    d = spark.createDataFrame([(1, "Abstract\nWe present X.\nReferences\n[1] A."), (2, "plain")], "doc_id long, text string")
    s = segments.sections(d)
    got = sorted((r.doc_id, r.section, r.start, r.end) for r in s.collect())
    assert got == [(1, "abstract", 0, 23), (1, "references", 23, 40), (2, "unknown", 0, 5)]
    at = segments.section_at(s, spark.createDataFrame([(1, 3), (1, 30), (2, 99)], "doc_id long, at long"))
    assert {(r.doc_id, r.at): r.section for r in at.collect()} == {(1, 3): "abstract", (1, 30): "references", (2, 99): "unknown"}


def test_position_context_and_ids(spark):
    df = spark.createDataFrame([("aXbX", "X"), ("aXb", "X"), ("aaa", "aa"), ("a", "")], "t string, v string")
    assert [r[0] for r in df.select(t.only_occurrence("t", "v")).collect()] == [None, 1, None, None]
    assert one(spark, "see PMC12345, and 10.1234/AbC). PMC12345", t.ids_in_text) == ["10.1234/abc", "pmc12345"]
    assert one(spark, "Using the aligners and settings", t.context_tokens) == ["align", "sett"]


def _over(spark, tmp_path, name, rows, schema, **tables):
    from mentionforge.plans.catalog import ORACLES, QUERIES
    from tests.oracle import same

    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    for table, (r, s) in tables.items():
        spark.createDataFrame(r, s).write.parquet(str(tmp_path / f"{table}.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    same(df, ORACLES[name], str(tmp_path))
    return df


def test_offsets_behind_texts_of_few_and_of_wide_characters(spark, tmp_path):
    rows = [*enumerate(("", "a", "ab", "abc", "😀", "a😀", "a😀b", "😀b", "😀😀😀", "😀" * 60)), (10, None)]
    _over(spark, tmp_path, "code_point_offsets", rows, "doc_id long, text string")


def test_a_text_is_split_once_for_its_tokens(spark, tmp_path):
    rows = [*enumerate((" ".join("w" * (k % 3) for k in range(n)) for n in (1, 16, 17, 64, 65, 112, 113, 400, 60000)))]
    df = _over(spark, tmp_path, "window_owner", rows, "doc_id long, text string")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "split(" not in above  # above the explosion it would be split again for each of its words


def test_only_names_are_counted(spark, tmp_path):
    rows = [(1, "One two three one two. One"), (1, "one two"), (2, "three"), (3, ""), (4, None)]
    df = _over(spark, tmp_path, "phrase_matches", rows, "doc_id long, text string", benchmark=([(1, "one two three four"), (2, "One"), (3, ""), (4, "three")], "item_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")  # the join lies below the count


def test_lines_are_dealt_out_by_size(spark, monkeypatch):
    """A larger table is more tasks, and neither a scan's task sorts lines nor do they move again for what follows by order."""
    from mentionforge import session
    from mentionforge.plans.catalog import QUERIES
    from tests.oracle import SMALL

    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    assert session.dealt(spark.read.parquet(f"{SMALL}/lineitem.parquet"), "l_orderkey").rdd.getNumPartitions() > 50
    plan = QUERIES["boundary_segments"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
