"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionforge.llm import ann_search, chat_format, minhash_dedup, packing, piece_encoding, quality_rules, secret_scan, substring_dedup, toxicity, url_filters
from mentionforge.llm.suffix_array import suffix_array

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, spans string"


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def word_salad(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- op1


def test_url_parts_and_longest_listed_rule(spark):
    urls = [None, "", "no scheme", "http://Sub.Example.ORG/es/x", "https://example.org/en/12?q", "http://notexample.org/es/", "http://a.com/de/#f", "http://org", "x://y.org/://z.com/de/", "http://a.com/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], url_filters.RULES_DDL)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(df, none).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("org/", "allow")
    assert got[6] == ("a.com", "/de/", "com/de/", "block")
    assert got[7] == ("org", "", None, "allow")
    assert got[8][:2] == ("y.org", "/://z.com/de/")
    assert got[9][2:] == ("com/fr/", "allow")


def labelled_urls(seed, n=400, signal=0.9):
    r, rows = random.Random(seed), []
    for i in range(n):
        spam = r.random() < 0.3
        host = r.choice(["pills", "casino"] if spam and r.random() < signal else ["news", "blog", "wiki"])
        rows.append((f"http://{host}.test/{r.choice(['en', 'de'])}/{i}", spam))
    return rows + [rows[0]] * 30 + [(rows[1][0], not rows[1][1])] * 5


def brute_rules(spark, rows, min_lift, z, min_support, min_rows, folds=5):
    """Every token set is counted: (tokens: bad urls, urls) of the rules."""
    from itertools import combinations

    votes = {}
    for u, bad in rows:
        if u is not None and bad is not None:
            votes.setdefault(u, []).append(bad)
    df = spark.createDataFrame([(u, sum(v) * 2 >= len(v)) for u, v in votes.items()], "url string, bad boolean")
    urls = df.select("bad", url_filters.url_tokens(F.col("url")).alias("t"), (F.pmod(F.xxhash64("url", F.lit(folds)), F.lit(folds)) == 0).alias("held")).collect()
    mined, held = [(set(x.t), x.bad) for x in urls if not x.held], [(set(x.t), x.bad) for x in urls if x.held]
    n, share = len(mined), sum(b for _, b in mined) / len(mined)
    counts = {}
    for t, bad in mined:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                x = counts.setdefault(c, [0, 0])
                x[0] += bad
                x[1] += 1
    rules = {}
    for c, (k, m) in counts.items():
        p = k / m
        low = (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
        if k >= min_rows and k >= min_support * n and p / share >= min_lift and low > share:
            rules[c] = (k, m)
    short = {c: v for c, v in rules.items() if not any(c[:i] + c[i + 1 :] in rules for i in range(len(c)))}
    fits = lambda c: [b for t, b in held if set(c) <= t]
    return {c: v for c, v in short.items() if fits(c) and sum(fits(c)) / len(fits(c)) > share}


@pytest.mark.parametrize(("signal", "lift", "z"), [(0.9, 1.5, 3.0), (0.4, 1.05, 0.3), (0.0, 1.5, 3.0)])
def test_mined_rules_match_brute_force(spark, signal, lift, z):
    rows = labelled_urls(4, signal=signal) + [(None, True), ("http://x.test/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filters.mine_rules(labelled, min_lift=lift, z=z, min_rows=10).collect()
    want = brute_rules(spark, rows, lift, z, 0.002, 10)
    assert {tuple(x.tokens): (x.n_bad, x.n_urls) for x in rules} == want
    assert (len(want) > 0) == (signal > 0)  # labels that have nothing to do with urls give no rule
    pages = spark.createDataFrame([(i, u, "clash", 7) for i, (u, _) in enumerate(rows + rows[:50])], "page_id long, url string, verdict string, host int")
    tokens = {x.url: set(x.t) for x in pages.select("url", url_filters.url_tokens(F.col("url")).alias("t")).collect()}
    got = url_filters.url_filter(pages, spark.createDataFrame(rules, url_filters.RULES_DDL)).collect()
    assert len(got) == pages.count()
    for x in got:
        fitting = [rule for rule in rules if x.url is not None and set(rule.tokens) <= tokens[x.url]]
        assert (x.verdict == "block") == bool(fitting)
        assert x.mined_confidence == max((rule.confidence for rule in fitting), default=None)


def test_urls_without_rows_labels_or_bounds(spark):
    rules = url_filters.mine_rules(spark.createDataFrame(labelled_urls(1), "url string, bad boolean"))
    assert url_filters.mine_rules(spark.createDataFrame([], "url string, bad boolean")).count() == 0
    assert url_filters.mine_rules(spark.createDataFrame([("http://a.b/", False)] * 40, "url string, bad boolean")).count() == 0
    empty = url_filters.url_filter(spark.createDataFrame([], "page_id long, url string"), rules)
    assert empty.count() == 0 and {"host", "path", "rule", "verdict"} <= set(empty.columns)
    long = "http://Casino.test/" + "a/" * 50_000 + "?q=" + "x" * 50_000
    r = url_filters.url_filter(spark.createDataFrame([(1, long)], "page_id long, url string"), rules).first()
    assert (r.host, r.path, r.verdict) == ("casino.test", "/" + "a/" * 50_000, "block")


def test_samples_are_bounded_and_hold_a_key_once(spark):
    from mentionforge.llm.common import bounded_sample

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = bounded_sample(df, "k", 1000).collect()
    assert 0 < len(got) < 1300 and len({r.k for r in got}) == len(got)
    assert sorted(got) == sorted(bounded_sample(df.repartition(7), "k", 1000).collect())
    assert all(r.id == 0 for r in got if r.k == "hot")


# --- op2


def test_quality_counts_match_brute_force(spark):
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x\u00a0y z\x0bq\x0c" + "line\n" * 4, "the # ** and\n\nthe # ** and\nof", word_salad(300, 1), word_salad(40, 2) + " " + word_salad(40, 2), "a " * 5000]
    for r in quality_rules.quality_rules(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(grams) < 1000 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_of_odd_tables(spark):
    docs = frame(spark, ["a b c d e f g h i j " * 8, None]).withColumn("_w", F.lit(1)).withColumn("_l", F.lit("x")).withColumn("n_words", F.lit(-1)).withColumn("failed_rules", F.lit(2))
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert (rows[0]._w, rows[0]._l, rows[0].n_words, rows[0].n_repeat_words) == (1, "x", 80, 80)
    assert (rows[1].n_words, rows[1].base_failed, rows[1].kept) == (0, True, False)
    empty = quality_rules.quality_rules(docs.where("false"))
    assert empty.count() == 0 and set(docs.columns) <= set(empty.columns)


def test_repeated_windows_of_random_texts(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("abc"[: r.randrange(1, 4)]) for _ in range(r.randrange(1, 60))) for _ in range(80)]
    for x in quality_rules.quality_rules(frame(spark, texts)).collect():
        w = texts[x.doc_id].split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        assert x.n_repeat_words == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)})


# --- op3


def jaccard_components(texts, width, percent):
    sets = []
    for t in texts:
        w = [x.lower() for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        old = list(root)
        for i in range(len(texts)):
            for j in range(i):
                n = len(sets[i] & sets[j])
                if n and 100 * n >= percent * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if old == root:
            break
    return root, [len(s) for s in sets]


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 6])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    base = word_salad(120, 5, 10**6)
    texts = [None, "", "a b", "A  B", "a b c"] + [word_salad(60, k, 10**6) for k in range(10)] + [base] * 3 + [edited(base, k % 4, k) for k in range(40)] + [word_salad(60, 3, 10**6).upper()]
    root, sizes = jaccard_components(texts, 4, 80)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, texts), width=4).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (root[i] == i) for i in range(len(texts)))


def test_near_duplicates_without_ids_or_rows(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    rows = minhash_dedup.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [None, 4, 4])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (4, 4, True), (4, 4, True)]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    copied, other = word_salad(60, 1, 10**6), word_salad(60, 2, 10**6)
    docs = frame(spark, [copied, copied, other, copied, None, copied], [1, 3, 3, 3, 3, None])
    kept = sorted((r.doc_id or -1, r.text or "") for r in minhash_dedup.keep_one(docs).collect())
    assert kept == sorted([(1, copied), (3, other), (3, ""), (-1, copied)])


# --- op4


def test_packing_is_whole_and_gapless(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "x", "<|endoftext|> é 𐍈\n\n  it's", word_salad(3000, 1), "a" * 5000, *[word_salad(k * 7, k) for k in range(30)]]
    pieces = packing.pack(frame(spark, texts).repartition(2), special=True).collect()
    ids = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        ids.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for d, x in enumerate(texts):
        parts = sorted(ids[d])
        whole = [i for _, part, _ in parts for i in part]
        assert whole == [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert [s for s, _, _ in parts] == np.cumsum([0] + [len(p) for _, p, _ in parts])[:-1].tolist()
        assert {n for _, _, n in parts} == {len(whole)}
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == 1024 or end & (end - 1) == 0
    assert packing.pack(frame(spark, [])).count() == 0


def test_added_tokens_get_their_id(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # the library's default setting
    docs = frame(spark, texts := ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n é", "<|endoftext", "plain  text", ""])
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    ids = {}
    for p in sorted(packing.pack(docs, special=True).collect(), key=lambda p: p.start):
        ids.setdefault(p.doc_id, []).extend(int.from_bytes(p.ids[i : i + 4], "little") for i in range(0, len(p.ids), 4))
    assert [ids[k] for k in range(6)] == want
    rows = entry.queries()["op4_packing"], corpus_pipeline.STAGES[-1][1]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (rows[0](spark, str(tmp_path)), rows[1](spark, docs, str(tmp_path))):
        assert {r.doc_id: r.doc_tokens for r in out.collect()} == {k: len(x) for k, x in enumerate(want)}


def test_packing_of_repeated_rows(spark):
    """A row that is there three times is packed three times; columns that share a name with the result's change nothing."""
    text = word_salad(700, 3)
    docs = frame(spark, [text, text, text, "x"], [4, 4, 4, None]).withColumn("sequence_id", F.lit(9)).withColumn("length", F.lit("clash"))
    pieces = packing.pack(docs.coalesce(1)).collect()
    whole = len(packing.encoding().encode_ordinary(text)) + 1
    assert sum(p.length for p in pieces if p.doc_id == 4) == 3 * whole and sum(p.length for p in pieces if p.doc_id is None) == 2
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()


# --- op5


def test_toxicity_learns_words_and_scores_whole_texts(spark):
    r = random.Random(6)
    texts, toxic = [], []
    for k in range(600):
        w = word_salad(60, k, 3000).split()
        bad = k % 3 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "grimword", "grimwords,"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += [None, "", "w1 " * 20000 + "vile"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    assert sum((got[i].score >= 0.5) == bool(t) for i, t in enumerate(toxic)) == len(toxic)
    assert got[600].score == got[601].score < 0.5
    assert [texts[602][s.start : s.end] for s in got[602].spans] == ["vile"]
    for s in got[0].spans:
        assert texts[0][s.start : s.end].strip(",") in ("vile", "grimword", "grimwords")
    kept = {x.doc_id for x in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i in got if got[i].score < 0.5}
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {x.score < 0.5 for x in toxicity.score_toxicity(docs, none).collect()} == {True}


def paths_of(model, words):
    """Weight of every labelling of the words behind a clean token, by its bits."""
    enter, leave, stay = model.move
    step, out = {(0, 0): 0.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}, {}
    for code in range(1 << len(words)):
        y = [code >> k & 1 for k in range(len(words))]
        out[code] = np.exp(sum(step[a, b] for a, b in zip([0, *y], y)) + sum(model.score(w) for w, b in zip(words, y) if b))
    return out


def test_forward_backward_equals_enumeration():
    """Log Z and marginals, of one text and of a sample, and the sample's expected steps."""
    m = toxicity.Model({"=bad": 1.3, "=worse": 2.2, "=mild": -0.7, "#3": 0.2}, np.array([-0.9, -0.2, 0.1]))
    texts = ["a", "bad", "a b bad c", "worse a mild bad d bad", "a a a a a a a", "bad bad", "a worse", ""]
    tag = toxicity._Tagger(m)
    sample = toxicity._Sample(m, texts, [1] * len(texts))
    solved = {int(d): (float(z), p[on]) for (ids, _, _, _, ons, _), zs, ps in sample.solve(m.move, sample.scores(np.array(list(m.weights.values())))) for d, z, p, on in zip(ids, zs, ps, ons)}
    for d, t in enumerate(texts):
        words = t.split()
        paths = paths_of(m, words)
        z = sum(paths.values())
        want = [sum(v for c, v in paths.items() if c >> k & 1) / z for k, w in enumerate(words) if m.score(w)]
        clean, marginals = tag.chain.run(*tag.hits(words))
        assert np.isclose(np.exp(clean), 1 / z) and np.allclose(marginals, want)
        assert np.isclose(solved[d][0], np.log(z)) and np.allclose(solved[d][1], want)
    labels = [np.where(g[4], 0.3, 0.0) for g in sample.groups]
    want = np.zeros(3)
    for t in texts:
        q = [0.3 if m.score(w) else 0.0 for w in t.split()]
        for a, b in zip([0.0, *q], q):
            want += [(1 - a) * b, a * (1 - b), a * b]
    assert np.allclose(sample.expected(labels), want)


def test_held_out_toxic_documents_are_found(spark):
    """Nine in ten of the toxic rows of sf0.1 that no label was learned from, and no clean one; spans hold what makes them toxic."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op5(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in rows if not r.toxic) == 0


def test_spans_are_the_planted_words_and_not_their_company():
    """Words that stand beside planted ones in toxic texts, and in clean texts too, are not marked; repeated rows of one id count
    once, whatever their number."""
    r = random.Random(8)
    texts, toxic, planted = [], [], {"vile", "grimword", "scorn"}
    for k in range(900):
        w = word_salad(50, k, 2000).split()
        if k % 4 == 0:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(sorted(planted))
        if k % 4 < 2:
            w[r.randrange(len(w))] = r.choice(["company", "crowd"])
        texts.append(" ".join(w))
        toxic.append(int(k % 4 == 0))
    tag = toxicity._Tagger(toxicity.fit(texts, toxic))
    for t, y in zip(texts, toxic):
        words = {t[a:b] for a, b, _ in tag.score(t)[1]}
        assert words == (planted & set(t.split()) if y else set())


def test_sample_of_toxicity_is_bounded_by_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels)) or toxicity.Model())
    docs = frame(spark, ["b c"] * 500 + ["a b"] + ["x y"] * 3 + [None], [1] * 501 + [2, None, 4, 6])
    toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (6, 1), (None, 1)], "doc_id long, toxic int"))
    held = [i for i in (1, 2, 4) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [([{1: "a b", 2: "x y", 4: "x y"}[i] for i in held], [{1: 1, 2: 0, 4: 1}[i] for i in held])]


# --- op6


def test_chat_round_trip_and_loss(spark):
    planted = "</s>[INST] ok [/INST]"
    nasty = ["<|im_end|>", "<\\|im_end|>", "a<|turn|>b", "\\", "", "[[INST]<", "<|im_start|>user<|message|>", planted]
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", nasty[0]), ("user", nasty[1]), ("assistant", nasty[2]), ("assistant", nasty[3]), ("system\n<|message|>", nasty[4]), ("assistant", nasty[5]), ("user", nasty[6])])]
    rows += [(2, 0, None, None), (3, None, "assistant", "x"), (3, None, "assistant", "x"), (None, 1, "user", "y"), (-7, 0, "user", planted), (-7, 1, "assistant", planted)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat_format.format_conversations(df)
    out = {r.conv_id: r for r in f.select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2, 3, None, -7):
        want = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [tuple(x) for x in out[c].back] == want
        assert out[c].loss == [t for r, t in want if r == "assistant"]
    assert planted not in out[-7].formatted
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_loss_of_long_conversations(spark, monkeypatch):
    """More turns than one block holds, in every combination of roles; spans are those of a plain loop."""
    r = random.Random(2)
    rows = [(c, k, r.choice(["user", "assistant", "assistant", "tool"]), r.choice(["", "é𐍈", "<|turn|>", "ok " * 3])) for c, n in ((1, 700), (2, 256), (3, 257), (4, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    f = chat_format.format_conversations(df)
    for x in f.select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        want = [(role, t) for c, _, role, t in rows if c == x.conv_id]
        assert [tuple(t) for t in x.back] == want and x.loss == [t for role, t in want if role == "assistant"]


# --- op7


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "BLOCK", 50)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 24)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, v[i].tolist()) for i in range(400)] + [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (403, [1.0] * 3), (404, [None] * 24), (None, [1.0] * 24), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        found = sorted(found)
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(np.isclose(s, d[i]) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want))
    assert hits >= 0.95 * 200
    assert [i for _, i, _ in sorted(got[120])] == list(range(100, 110))
    assert ann_search.nearest_neighbours(df.where("false"), df).count() == 0


def exact_neighbours(v, queries, k):
    """(ids, distances) of the k nearest rows of v for each query row, but itself; ties to the smaller id."""
    out = {}
    for q in queries:
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        out[q] = [i for i in np.lexsort((np.arange(len(v)), d)) if i != q][:k], d
    return out


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_recall_when_few_lists_are_probed(spark, monkeypatch, spread):
    """Clustered vectors, 120 lists, four probes at least, against brute force."""
    monkeypatch.setattr(ann_search, "LEAST_PROBES", 4)
    monkeypatch.setattr(ann_search, "BLOCK", 64)
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((60, 32))[rng.integers(0, 60, 3000)] + spread * rng.standard_normal((3000, 32))).astype(np.float32)
    asked_lists = []
    monkeypatch.setattr(ann_search, "probes_for", lambda *a, f=ann_search.probes_for: asked_lists.append(f(*a)) or asked_lists[0])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id % 100 = 0"), k=10, n_lists=120).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact_neighbours(v, range(0, 3000, 100), 10)
    assert asked_lists[0] < 120 and set(got) == set(want)
    assert all([k for k, _, _ in sorted(g)] == list(range(1, 11)) for g in got.values())
    assert all(np.isclose(s, want[q][1][i], rtol=1e-12) for q, g in got.items() for _, i, s in g)
    assert sum(len({i for _, i, _ in g} & set(want[q][0])) for q, g in got.items()) >= 0.95 * 10 * len(want)


def test_near_copies_of_long_vectors_are_not_lost_to_rounding(spark, monkeypatch):
    """Exact copies and rows a hair away, far from the origin: what lies at the k-th distance stays, ties by id."""
    monkeypatch.setattr(ann_search, "BLOCK", 16)
    rng = np.random.default_rng(9)
    v = (1000 + rng.standard_normal((300, 16))).astype(np.float32)
    v[40:80] = v[40]
    v[80:120] = np.nextafter(v[40], np.float32(np.inf))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, (want, _) in exact_neighbours(v, [40, 60, 80, 100], 10).items():
        assert [i for _, i in sorted(got[q])] == want


def test_vectors_of_every_length_are_searched(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "BLOCK", 20)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8 if i % 4 else 3 if i % 8 else 5).astype(np.float32)) for i in range(400)]
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in rows], "vec_id long, embedding array<float>, list string")
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id % 20 = 0 or vec_id < 8"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in [*range(0, 400, 20), *range(8)]:
        near = sorted((float(np.sqrt(((x.astype(float) - rows[q][1].astype(float)) ** 2).sum())), i) for i, x in rows if i != q and len(x) == len(rows[q][1]))[:5]
        if len(rows[q][1]) != 8:
            assert [i for _, i in sorted(got[q])] == [i for _, i in near]  # lists of other lengths are scanned whole
        assert {len(rows[i][1]) for _, i in got[q]} == {len(rows[q][1])} and len(got[q]) == 5


def test_doubles_are_compared_as_doubles(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "BLOCK", 20)
    rng = np.random.default_rng(6)
    far = rng.standard_normal((60, 6))
    rows = [(i, far[i].tolist()) for i in range(60)] + [(100 + i, [1.0 + i * 1e-9, 0.5, 2.0, 1.0, 1.0, 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id = 100 or vec_id = 5"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [i for _, i, _ in sorted(got[100])] == list(range(101, 111))
    for _, i, score in got[100]:
        assert score == pytest.approx(float(np.linalg.norm(np.array(dict(rows)[i]) - dict(rows)[100])), rel=1e-12) and score > 0
    near = sorted((float(np.linalg.norm(np.array(v) - far[5])), i) for i, v in rows if i != 5)[:10]
    assert len({i for _, i, _ in got[5]} & {i for _, i in near}) >= 9


# --- op8


def brute_repeats(rows):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append((d, len(t), [i for i in range(len(t)) if gone[i]], hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).digest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "runs", "size", "most"), [(0, 10**6, 8 * 10**6, 16_384), (1, 10**6, 8 * 10**6, 16_384), (2, 100, 900, 16_384), (3, 60, 700, 3), (4, 60, 700, 1)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, runs, size, most):
    """Whole, in many buckets and blocks, and in more of them than ranges."""
    for name, value in (("BUCKET_RUNS", runs), ("BLOCK_BYTES", size), ("MOST", most), ("DEALT", 500 if most < 4 else 10**6)):
        monkeypatch.setattr(substring_dedup, name, value)
    r = random.Random(seed)
    passage = ["".join(r.choice("abcdé \0") for _ in range(n)) for n in (49, 50, 51, 90, 200, 700)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 300, "ab" * 200, "\n" * 120, "\0" * 130, "a\0" * 60]
    for k in range(40):
        parts = [word_salad(r.randrange(1, 30), (seed, k).__hash__())] + [r.choice(passage) + "\0" * r.randrange(3) for _ in range(r.randrange(4))]
        r.shuffle(parts)
        texts.append("".join(parts))
    texts += [texts[9], texts[9], texts[4], texts[10][5:] + "é"]
    docs = frame(spark, texts)
    got = sorted((x.doc_id, x._bytes, [i for s in x._spans for i in range(s.start, s.end)], bytes(x._kept)) for x in substring_dedup.remove_repeats(docs, digest=True).collect())
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_repeats_edges(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    rows = substring_dedup.remove_repeats(frame(spark, ["q" * 80, "q" * 80, "q" * 80, "p"], [None, 2, 2, 5])).collect()
    assert sum(len(r._spans) for r in rows) == 0 and len(rows) == 4
    kept = substring_dedup.drop_repeats(frame(spark, ["é" * 40, "xé" + "é" * 40]))
    assert kept.columns == frame(spark, []).columns
    assert {r.doc_id: r.text for r in kept.collect()} == {0: "é" * 40, 1: "x"}


def test_suffix_array_equals_sorting():
    r = random.Random(8)
    for _ in range(400):
        d = bytes(r.choice(b"abc"[: r.randrange(1, 4)]) for _ in range(r.randrange(60)))
        assert suffix_array(d) == sorted(range(len(d)), key=lambda i: d[i:])


# --- op9


def test_base_spans_follow_the_patterns():
    text = 'Api_Key: "abcdefghijkl" token: token: abcdefghijklmn AKIA0123456789ABCD AKIAX deadbeefdeadbeef deadbeef é password=aaaaaaaaaaa PASSWD = "0123456789abcdef"'
    want = []
    for kind, pattern, ok in ((0, r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16)):
        want += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    assert [s[:3] for s in secret_scan.base_spans(text)] == sorted(want)


def test_repositories_count_too(spark):
    """An example in four repositories of one owner is copied, one in three is live; three owners make a copy whatever their
    repositories; null owners and repositories are one each."""
    key = ["AKIA" + c * 16 for c in "ABCDEF"]
    opaque = "aB3dE5fG7hJ9kL2mN4pQ6rS8tU"
    held = [(key[0], "o", r) for r in "abcd"] + [(key[1], "o", r) for r in "abc"] + [(key[2], o, "a") for o in "opq"] + [(key[3], o, r) for o in "op" for r in "ab"] + [(key[4], None, None)] * 5 + [(opaque, "o", r) for r in "abcd"] + [(opaque[::-1], "o", r) for r in "abc"]
    docs = spark.createDataFrame([(i, f"x {t} y", l, s, 1) for i, (t, s, l) in enumerate(held)], "doc_id long, text string, lang string, source string, n_chars long")
    live = {}
    for r in secret_scan.scan_secrets(docs).collect():
        live.setdefault(held[r.doc_id][0], set()).update(s.live for s in r.secrets)
    assert live == {key[0]: {False}, key[1]: {True}, key[2]: {False}, key[3]: {False}, key[4]: {True}, opaque: set(), opaque[::-1]: {True}}


def test_opaque_spans_keep_clear_of_base_ones():
    r = random.Random(5)
    for _ in range(200):
        text = " ".join(r.choice(["token=" + "aB3" * 9, "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "aB3dE5fG7hJ9kL2mN4pQ6rS8tU", "x/aB3dE5fG7hJ9kL2mN4p0123456789abcdef"]) for _ in range(6))
        base = secret_scan.base_spans(text)
        want = [m.span() for m in secret_scan.OPAQUE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b, _ in base) and all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")) and secret_scan.entropy(m[0]) >= 3.5]
        assert [(s[0], s[2]) for s in secret_scan.opaque_spans(text, base)] == want


def test_ownership_separates_copied_from_live(spark):
    copied, own = "AKIA" + "A1B2C3D4E5F6G7H8", "AKIA" + "ZZZZC3D4E5F6G7H8"
    opaque = "aB3dE5fG7hJ9kL2mN4pQ6rS8tU"
    texts = [None, "", f"x {copied} y"] * 4 + [f"é {own} {opaque} z", f"é {own} {opaque} z"]
    docs = frame(spark, texts)
    docs = docs.withColumn("source", F.concat(F.lit("o"), (F.col("doc_id") < 12).cast("int") * F.col("doc_id")))
    got = {r.doc_id: [(secret_scan.KINDS[s.kind], s.start, s.end, s.live) for s in r.secrets] for r in secret_scan.scan_secrets(docs).collect()}
    assert len(got) == len(texts)
    assert got[2] == [("access", 2, 22, False)] and got[0] == got[1] == []
    assert got[12] == got[13] == [("access", 2, 22, True), ("opaque", 23, 49, True)]
    clean = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(docs).collect()}
    assert clean[2][0] == texts[2] and clean[12][0] == "é [REDACTED] [REDACTED] z" and clean[12][1] == len(clean[12][0]) and clean[0][0] is None
    assert secret_scan.scan_secrets(docs.where("false")).count() == 0


# --- op10


def library(path=None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(path or public_tokenizers.path("piece_bpe_32k.model")))


def odd_texts():
    r = random.Random(1)
    texts = [None, "", " ", "  a  b ", "Hello  world, it's fine", "\n\nfoo \t é 𐍈", "².a, a.b\0", "x" * 900, "ab" * 700 + " c " + "\n" * 50, "ß" * 333, "中文字典" * 90, word_salad(400, 1)]
    texts += ["".join(r.choice("the of and ionéß\n.,𐍈 中文字") for _ in range(r.randrange(1, 400))) for _ in range(60)]
    return texts + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABC012-_/") for _ in range(500)) for _ in range(20)]


def pieces_by_row(encoded):
    """ids of each (doc_id, text_hash), as often as the row came out."""
    parts = {}
    for x in encoded.collect():
        parts.setdefault((x.doc_id, x.text_hash), {}).setdefault(x.chunk, []).append((x.n_chunks, np.frombuffer(x.ids, "<u4").tolist()))
    out = {}
    for (d, _), chunks in parts.items():
        n, copies = len(chunks), {len(c) for c in chunks.values()}
        assert sorted(chunks) == list(range(n)) and len(copies) == 1 and all(x == c[0] and x[0] == n for c in chunks.values() for x in c)
        out.setdefault(d, []).extend([[i for k in range(n) for i in chunks[k][0][1]]] * copies.pop())
    return out


@pytest.mark.parametrize("chunk", [64, 100, piece_encoding.CHUNK])
def test_pieces_equal_the_library(spark, chunk):
    """The model as it is, chunked and not, with repeated rows."""
    texts = odd_texts()
    ids = [*range(len(texts)), 7, 7, 4, 1, 1]
    encoded = piece_encoding.encode_pieces(frame(spark, [texts[i] for i in ids], ids), chunk=chunk)
    got, sp = pieces_by_row(encoded), library()
    for i, t in enumerate(texts):
        assert got[i] == [sp.encode(t or "")] * ids.count(i), t
    back = {}
    for x in piece_encoding.decode_pieces(encoded).collect():
        back.setdefault(x.doc_id, {})[x.chunk] = bytes(x.bytes)
    assert all(b"".join(c for _, c in sorted(back[i].items())) == (t or "").encode() for i, t in enumerate(texts))
    assert piece_encoding.encode_pieces(frame(spark, []), chunk=chunk).count() == 0


def test_pieces_of_documents_equal_the_library(spark):
    from tests.oracle import SMALL

    docs, sp = spark.read.parquet(f"{SMALL}/documents.parquet"), library()
    got = pieces_by_row(piece_encoding.encode_pieces(docs, chunk=2000))
    for r in docs.collect():
        assert got[r.doc_id] == [sp.encode(r.text or "")]


def test_paths_equal_merging_by_rank():
    """Small vocabularies with odd ranks, where merges that come late can be better ones: the path, and chunks of it, against
    plain merging of the whole text."""
    r = random.Random(3)
    for _ in range(300):
        made = list(dict.fromkeys("".join(r.choice("ab") for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(1, 9))))
        ranks = r.sample(range(100), len(made) + 2)
        model = piece_encoding.Pieces([(p, -float(x), "normal") for p, x in zip([*made, "a", "b"], ranks)], prefix=False)
        text = "".join(r.choice("aaabbc") for _ in range(r.randrange(40, 90)))
        want = list(text)
        while True:
            pairs = [(model.score[x + y], -k) for k, (x, y) in enumerate(zip(want, want[1:])) if x + y in model.score]
            if not pairs:
                break
            k = -max(pairs)[1]
            want[k : k + 2] = ["".join(want[k : k + 2])]
        assert model.solve(text) == want == model.merged(text)
        cut = r.randrange(2 * model.reach, 30)
        left, part = text[cut - 2 * model.reach : cut], text[cut:]
        enter = model.states(left)
        m = model.matrix(left, part, enter, None)
        ends = [len("".join(want[:k])) for k in range(len(want) + 1)]
        k = max(k for k, e in enumerate(ends) if e <= cut)
        if k:
            s, before = cut - ends[k], want[k - 1]
            assert m[enter.index((s, before)), 0] == 0
            assert model.solve(left[len(left) - s :] + part, before, s) == want[k:]


def unigram_model(path):
    """The model file's pieces as a unigram model of the library, with scores small enough for its float sums."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    for k, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -float(1 + (k * 7919) % 4093) if p.score > -1e8 else -5000.0
    open(path, "wb").write(m.SerializeToString())
    return library(path)


@pytest.mark.parametrize("chunk", [64, piece_encoding.CHUNK])
def test_unigram_models_get_a_best_path(spark, tmp_path, chunk):
    path = tmp_path / "unigram.model"
    sp, texts = unigram_model(path), odd_texts()
    got = pieces_by_row(piece_encoding.encode_pieces(frame(spark, texts), str(path), chunk))
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    # the library adds floats and may settle ties elsewhere; a byte piece counts as it does there
    assert all(score(got[i][0]) >= score(sp.encode(t or "")) and sp.decode(got[i][0]) == sp.decode(sp.encode(t or "")) for i, t in enumerate(texts))
    assert np.mean([got[i][0] == sp.encode(t or "") for i, t in enumerate(texts)]) >= 0.9


# --- pipeline


def test_pipeline_equals_brute_force(spark):
    """Every stage on what its predecessor kept, against plain Python."""
    import corpus_pipeline
    import public_tokenizers
    from tests.oracle import SMALL
    from tokenizers import Tokenizer

    docs, stages = spark.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns = docs.columns
    of = lambda df: {r.doc_id: r for r in df.collect()}

    def step(name, docs):
        out = stages[name](spark, docs, SMALL).persist()
        assert out.columns == columns and out.count() == out.select("doc_id").distinct().count()
        return out, of(docs), of(out)

    kept, before, after = step("toxicity", docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    learned = [i for i in sorted(labels) if i in before and zlib.crc32(str(i).encode()) % 5 and before[i].text is not None and len(before[i].text) <= toxicity.MOST_CHARS]
    tag = toxicity._Tagger(toxicity.fit([before[i].text for i in learned], [labels[i] for i in learned]))
    assert after == {i: r for i, r in before.items() if tag.score(r.text or "")[0] < 0.5}

    kept, before, after = step("minhash_dedup", kept)
    order = sorted(before)
    root, _ = jaccard_components([before[i].text for i in order], 5, 80)
    assert after == {i: before[i] for k, i in enumerate(order) if root[k] == k}

    kept, before, after = step("suffix_array_dedup", kept)
    left = {d: gone for d, _, gone, _ in brute_repeats([(i, (r.text or "").encode()) for i, r in before.items()])}
    for i, r in before.items():
        text, gone = (r.text or "").encode(), set(left[i])
        want = bytes(b for k, b in enumerate(text) if k not in gone).decode("utf-8", "ignore") if gone else r.text
        assert tuple(after[i]) == tuple((before[i].asDict() | {"text": want, "n_chars": len(want) if gone else r.n_chars}).values())
    assert set(after) == set(before)

    kept, before, after = step("secret_scans", kept)
    spans = {i: (b := secret_scan.base_spans(r.text or "")) + secret_scan.opaque_spans(r.text or "", b) for i, r in before.items()}
    owners, places = {}, {}
    for i, found in spans.items():
        for _, _, _, s in found:
            owners.setdefault(s, set()).add(before[i].source or "")
            places.setdefault(s, set()).add((before[i].source or "", before[i].lang or ""))
    for i, r in before.items():
        text, at = "", 0
        for a, _, e, s in sorted(spans[i]):
            if len(owners[s]) < secret_scan.COPIED_OWNERS and len(places[s]) < secret_scan.COPIED_REPOSITORIES:
                if a >= at:
                    text += r.text[at:a] + "[REDACTED]"
                at = max(at, e)
        assert after[i].text == (text + r.text[at:] if at else r.text)
    assert set(after) == set(before)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for p in corpus_pipeline.run(spark, SMALL).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(pieces) == set(after)
    for i, r in after.items():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for start, n, crc, total in sorted(pieces[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            at += n
        assert at == len(ids)
    for held in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline
    from tests.oracle import SMALL

    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    top = 10**9
    odd = [(None, None, None, None, None), (None, "a b c " * 200, "en", "x", 5), (top, None, "en", "x", 0), (top + 1, "", "en", "x", 0), (top + 2, "w " * 50000, None, None, None), (top + 3, 'tok = "abc"', "en", "x", 1), (top + 3, 'tok = "abc"', "en", "x", 1)]
    full = base.limit(20).unionByName(spark.createDataFrame(odd, base.schema)).withColumn("kept", F.lit("clash")).withColumn("score", F.lit(1))
    for docs in (full, base.where("false")):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            n = docs.count()
            docs = stage(spark, docs, SMALL).persist()
            assert docs.columns == columns and docs.count() <= n
        packed = packing.pack(docs)
        assert (packed.count() == 0) == (docs.count() == 0)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, full, SMALL).collect()}
    assert {None, top, top + 1, top + 2, top + 3} <= kept


HELPERS = ["_id", "_hash", "_live", "_block", "_bytes", "_spans", "_kept", "_r", "doc_id_", "root", "rep", "n", "grp", "size", "block", "kind", "secrets", "text_hash", "score", "kept", "component_id", "n_shingles", "found", "owner", "repository", "x2"]


def test_stages_keep_columns_of_any_name(spark):
    """Every name that a stage uses inside comes back as it was."""
    import corpus_pipeline
    from tests.oracle import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    for k, name in enumerate(HELPERS):
        docs = docs.withColumn(name, F.concat_ws("-", F.lit(name), "doc_id") if k % 2 else F.col("doc_id") * 100 + k)
    docs = docs.persist()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).persist()
        assert out.columns == docs.columns, name
        want = {r.doc_id: tuple(r) for r in stage(spark, plain, SMALL).collect()}
        assert {r.doc_id: tuple(r)[:5] for r in out.collect()} == want, name
        for r in out.collect():
            assert all(r[c] == (f"{c}-{r.doc_id}" if k % 2 else r.doc_id * 100 + k) for k, c in enumerate(HELPERS)), name
        docs, plain = out, out.select(*plain.columns)
    assert packing.pack(docs).count() == packing.pack(plain).count()
    pages = spark.createDataFrame([(1, "http://a.com/de/", "r", "m", "r2")], "page_id long, url string, _r string, _R_ string, mined_rule string")
    row = url_filters.url_filter(pages, spark.createDataFrame([], url_filters.RULES_DDL)).first()
    assert (row["_r"], row["_R_"], row.rule, row.verdict, row.mined_rule) == ("r", "m", "com/de/", "block", None)
