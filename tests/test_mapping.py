import random
import re
import time

import pytest

from mentionforge.functions import text as t
from mentionforge.operators import contracts as ct
from mentionforge.operators import mapping as mp
from mentionforge.operators import segments
from pyspark.sql import functions as F

FIELDS = "struct<software:boolean,versions:boolean,created:boolean,used:boolean,shared:boolean,sentiment:boolean>"
TEXT = "We  ran\r\nToolkit 2.1 and Other 3 with Odd and Split thing.\n\n\n\nEnd"
ALL = (True,) * 6


def span(text, word, ident, kind, aligned=True, segments_=None):
    a = text.index(word)
    return ident, kind, segments_ or [(a, a + len(word))], aligned


def mapped(spark, spans, relations=(), coverage=None, text=TEXT, policy=None):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    s = spark.createDataFrame([(1, *x) for x in spans], "doc_id long, id string, type string, segments array<struct<start:bigint,end:bigint>>, aligned boolean")
    r = spark.createDataFrame([(1, *x) for x in relations], "doc_id long, id string, kind string, source string, target string")
    c = spark.createDataFrame([(1, *x) for x in (coverage if coverage is not None else [(0, len(text), ALL)])], f"doc_id long, start bigint, end bigint, fields {FIELDS}")
    policy = policy or mp.Policy(software={"tool": {"used": True}, "bare": {}}, versions=["ver"], relations=["of"], ignored=["note"])
    out = mp.map_annotations(docs, s, r, c, policy)
    found = {x.id: x for x in ct.occurrence_problems(out["occurrences"]).collect()}
    return found, sorted((x.id, x.code) for x in out["exclusions"].collect()), sorted((x.start, x.end, x.status, tuple(x.fields)) for x in out["coverage"].collect())


def test_mapping_of_a_good_document(spark):
    found, left_out, covered = mapped(spark, [span(TEXT, "Toolkit", "T1", "tool"), span(TEXT, "2.1", "T2", "ver"), span(TEXT, "Odd", "T3", "bare"), span(TEXT, "with", "T4", "note")], [("R1", "of", "T2", "T1"), ("R2", "other", "T2", "T3")])
    a, b = found["T1"], found["T3"]
    assert a.problems == b.problems == [] and left_out == []
    assert (a.name, a.version_status, a.intents, [e.text for e in a.version_links]) == ("Toolkit", "explicit", ["used"], ["2.1"])
    assert (b.name, b.version_status, b.intents, b.context_sentence) == ("Odd", "absent", None, "Toolkit 2.1 and Other 3 with Odd and Split thing.")
    n = len("We ran\nToolkit 2.1 and Other 3 with Odd and Split thing.\n\nEnd")
    assert covered == [(0, n, "complete", ALL)]


def test_what_is_left_out(spark):
    at = TEXT.index("Split")
    spans = [
        span(TEXT, "Toolkit", "T1", "tool"), span(TEXT, "Toolkit 2.1", "T5", "tool"), span(TEXT, "Odd", "T3", "unknown"), span(TEXT, "Other", "T4", "tool", aligned=False), span(TEXT, "3", "T6", "ver"),
        span(TEXT, "x", "T7", "tool", segments_=[(at, at + 5), (at + 6, at + 11)]) if "x" in TEXT else ("T7", "tool", [(at, at + 5), (at + 6, at + 11)], True), ("T8", "tool", [(3, 7)], True),
    ]
    found, left_out, covered = mapped(spark, spans, [("R1", "of", "T6", "T4"), ("R2", "of", "T6", "gone")])
    assert found == {}
    assert left_out == sorted([("T1", "OVERLAPPING_ENTITY"), ("T5", "OVERLAPPING_ENTITY"), ("T3", "UNMAPPED_TYPE"), ("T4", "ALIGNMENT_UNRESOLVED"), ("T7", "DISCONTINUOUS_SPAN"), ("T8", "ALIGNMENT_UNRESOLVED"), ("R1", "UNRESOLVED_VERSION_RELATION"), ("R2", "UNRESOLVED_VERSION_RELATION"), ("T6", "UNLINKED_VERSION")])
    assert all(status == "partial" and not any(fields) for _, _, status, fields in covered)  # T8 has no place, so nothing is sure
    assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_unsure_versions_and_partial_coverage(spark):
    half = TEXT.index(" with")
    found, left_out, covered = mapped(spark, [span(TEXT, "Toolkit", "T1", "tool"), span(TEXT, "2.1", "T2", "ver"), span(TEXT, "Split", "T9", "tool")], coverage=[(0, half, ALL)])
    assert (found["T1"].version_status, found["T1"].known.versions, found["T1"].problems) == ("ambiguous", False, [])
    assert left_out == [("T2", "UNLINKED_VERSION"), ("T9", "OUTSIDE_COVERAGE")]
    assert [(s, f[0], f[1]) for _, _, s, f in covered] == [("complete", True, False)]
    with pytest.raises(Exception, match="ALIGNMENT_UNRESOLVED"):
        mapped(spark, [], coverage=[(0, 3, ALL)])
    assert mapped(spark, [], coverage=[]) == ({}, [], [])


def test_projection_equals_a_map_of_places(spark):
    from mentionforge.operators.annotation import normal_map

    r, rows = random.Random(3), []
    for k in range(300):
        text = "".join(r.choice(["a", "b ", " ", "\t", "\n", "\r\n", "\r", " ", "é"]) for _ in range(r.randrange(1, 14)))
        a = r.randrange(len(text))
        rows.append((k, text, a, r.randrange(a + 1, len(text) + 1)))
    df = spark.createDataFrame(rows, "k int, text string, a int, b int")
    for x in df.select("*", mp.project(F.col("text"), F.col("a"), F.col("b")).alias("p"), t.normalize_v2(F.col("text")).alias("norm")).collect():
        if x.p:  # what it becomes is the normal form of what it was, and both sides of it are those of the rest
            one = spark_norm(x.text)
            assert one == x.norm and x.norm[x.p.start : x.p.end] == spark_norm(x.text[x.a : x.b])
            assert x.norm[: x.p.start] == spark_norm(x.text[: x.a]) and x.norm[x.p.end :] == spark_norm(x.text[x.b :])
        else:
            assert spark_norm(x.text[: x.a]) + spark_norm(x.text[x.a : x.b]) + spark_norm(x.text[x.b :]) != spark_norm(x.text)
    assert normal_map("a\r\nb")[0] == "a\nb"


def spark_norm(text):
    import re

    return re.sub(r"\r\n?|\n{3,}|[ \t]+| ", lambda m: "\n" if m[0][0] == "\r" else "\n\n" if m[0][0] == "\n" else " ", text)


def test_legacy_rows_by_their_reported_ids(spark):
    docs = spark.createDataFrame([("d", "Use NumPy now")], "document_id string, text string")
    ddl = "document_id string, ordinal int, name string, name_span struct<start:bigint,end:bigint>, version string, intents array<string>, sentiment string, mention_id string"
    rows = [("d", 0, "numpy", (4, 9), "1", ["used"], None, None), ("d", 1, "NumPy", (4, 9), "1", ["used"], None, "x"), ("d", 2, "SciPy", (4, 9), None, None, "mixed", "x"), ("d", 3, "R", None, " ", None, None, None)]
    got = sorted((r.mention_id.split("|")[-1], r.name, r.versions, r.intents, r.ordinals) for r in mp.convert_legacy(spark.createDataFrame(rows, ddl), docs).collect())
    assert got == [("4:9", "NumPy", ["1"], ["used"], [0, 1]), ("reported:x", "SciPy", [], None, [2]), ("unaligned:3", "R", [], None, [3])]
    with pytest.raises(Exception, match="UNKNOWN_DOCUMENT"):
        mp.convert_legacy(spark.createDataFrame([("gone", *rows[0][1:])], ddl), docs).collect()


@pytest.mark.parametrize("most", [3, 11, 40])
def test_task_regions_tile_the_text(spark, most):
    """Each region is the longest that ends a sentence and fits, or a hard one where none does; contexts are one sentence more."""
    r = random.Random(most)
    texts = ["".join(r.choice(["word ", "a. ", "b! ", "\n\n", "\n \n", "x" * 9, "? ", "é\u2003", "\x1c"]) for _ in range(r.randrange(0, 40))) for _ in range(200)]
    got = {}
    for x in segments.task_regions(spark.createDataFrame([*enumerate(texts), (999, None), (0, texts[0])], "doc_id long, text string"), most).orderBy("start").collect():
        got.setdefault(x.doc_id, []).append(tuple(x)[2:])
    for k, text in enumerate(texts):
        parts = got.get(k, [])
        assert "".join(text[a:b] for a, b, *_ in parts) == text
        edges = [0, *(m.end() for m in re.finditer(r"\n\s*\n", text)), len(text)]
        for a, b, low, high, hard in parts:
            p, q = next((p, q) for p, q in zip(edges, edges[1:]) if p <= a < q)
            stops = [p] + [p + m.end() for m in re.finditer(r"(?<=[.!?])\s+", text[p:q])] + [q]
            fits = [e for e in stops if a < e <= a + most]
            assert b == (max(fits) if fits else a + most) and hard == (a not in stops or b not in stops)
            assert low == max([e for e in stops if e < a] + [p], default=p) if a - most <= max([e for e in stops if e < a] + [p]) else low == a - most
            assert high == min(min([e for e in stops if e > b] + [q]), b + most) or b == q == high


def test_tasks_of_two_texts_of_one_id(spark):
    """Each region is its own text's, and its id that text's revision."""
    rows = [(7, "One. Two."), (7, "Three. Four."), (8, "One. Two.")]
    both = segments.annotation_tasks(spark.createDataFrame(rows, "doc_id long, text string"), "p", "h").collect()
    each = [x for row in rows for x in segments.annotation_tasks(spark.createDataFrame([row], "doc_id long, text string"), "p", "h").collect()]
    assert sorted(map(tuple, both)) == sorted(map(tuple, each)) and len({x.task_id for x in both}) == 3


def test_owner_of_a_token_is_where_it_lies_deepest(spark):
    for size, capacity, overlap in ((0, 5, 2), (1, 5, 2), (5, 5, 2), (23, 5, 4), (23, 7, 0), (40, 10, 3)):
        starts = [a for a in range(0, max(size - overlap, 1), capacity - overlap)]
        windows = [(a, min(a + capacity, size)) for a in starts]
        want = [max((min(t - a, b - 1 - t), -k) for k, (a, b) in enumerate(windows) if a <= t < b)[1] * -1 for t in range(size)]
        tokens = spark.range(-1, size + 2).select(F.col("id").cast("int").alias("token"), F.lit(size).alias("size"))
        got = [x.window for x in segments.window_owner(tokens, capacity, overlap).orderBy("token").collect()]
        assert got == [None, *want, None, None]
        scored = spark.createDataFrame([(t, size, k, k * 100 + t) for k, (a, b) in enumerate(windows) for t in range(a, b)] or [(9, 0, 0, 0)], "token int, size int, window int, score int")
        assert sorted(x.score for x in segments.stitched(scored, capacity, overlap).collect()) == sorted(k * 100 + t for t, k in enumerate(want))


def test_article_sentences_take_linear_time():
    text = "Some words of a sentence. Then " * 8000
    began = time.perf_counter()
    assert len(segments.article_sentences(text)) == 8001 and time.perf_counter() - began < 1


def test_article_sentences_mind_citations_and_abbreviations():
    text = "We used R v. 3 (Fig. 2).4,5 Next U.S.A. was seen.12 but not this. Dr. No et al. ran 1.5 it!  Done"
    assert [text[a:b] for a, b in segments.article_sentences(text)] == ["We used R v. 3 (Fig. 2).4,5", "Next U.S.A. was seen.12 but not this.", "Dr. No et al. ran 1.5 it!", "Done"]
    assert [x for a, b in segments.article_sentences("It ran.3 Then more.") for x in ["It ran.3 Then more."[a:b]]] == ["It ran.3", "Then more."]
    assert segments.article_sentences("  ") == []
