"""Spelling variants, the quality classifier and the token alignment against brute force, on tables with nulls, empties, repeats, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from veridex.llm import quality_trees, queries, spelling, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, key string, batch string, quality string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, None, "s", -1, "w", "k", "b", "q") for i, t in pairs], SCHEMA)


def words_of(docs):
    seen = collections.Counter()
    for d, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants(docs):
    n = words_of(docs)
    found = {w: sorted((x for x in n if x != w and near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in found.items()}
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def spelled(rng):
    base = ["".join(rng.choice("abcdeéÿß") for _ in range(rng.randint(5, 8))) for _ in range(12)]
    made = []
    for _ in range(1500):
        w = rng.choice(base[: rng.randint(1, 12)])
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        made.append(rng.choice([w, w.upper(), w.capitalize()]))
    return made


@pytest.mark.parametrize("few", [0, 3, 32])
def test_spelling_variants(spark, few):
    rng = random.Random(few)
    made = spelled(rng)
    docs = [(k, " ,1-\n".join(made[k * 50 : k * 50 + 50])) for k in range(30)]
    letters = "abcdefg"
    anagrams = ["".join(rng.sample(letters, 7)) for _ in range(150)]  # many words on one key
    docs += [(100, " ".join(anagrams * 3)), (101, " ".join(w[:3] + "x" + w[4:] for w in anagrams[:40] * 4))]
    docs += [(40, None), (41, ""), (42, "éé ×÷ 123"), (None, "abcde abcde abcde"), (3, docs[3][1]), (3, docs[3][1]), (43, ("z" * 5000 + " ") * 7 + ("z" * 4999 + " ") * 3)]
    docs += [(200 + k, " ".join(["q" * (8 - k) + "r" * k] * n)) for k, n in enumerate((60, 26, 11, 4))]  # a chain of forms
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame(spark, docs), few).collect())
    assert got == variants(docs)
    assert next(r for r in got if r[0] == "qqqqqrrr")[1:3] == ("qqqqqqrr", "qqqqqqqq")


def test_letter_values_differ():
    """No letter's value, nor the difference of two, is that of another letter or pair, so that a near pair has one key."""
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    values = [c**spelling.POWER for c in letters]
    changes = [a - b for a in values for b in values if a != b] + values + [-v for v in values]
    assert len(set(changes)) == len(changes) and max(map(abs, changes)) < spelling.MODULUS // 2


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert spelling.spelling_variants(none).count() == 0
    assert token_alignment.token_alignment(none).count() == 0
    assert quality_trees.quality_scores(none, quality_trees.fit(none, labels)).count() == 0


ODD = ["", None, " ", "  a  b ", "a\n b", "x \t y", "tail ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁mark here", "a ▁ b", "ﬁne ½ café café 日本語 \U0001f642\U0001f642", "\n", "\x00 a \x01", "a  b 　 c", "a  " * 50, "word\r ;\r x", "\x1c x \x1f y\x85 z", "x" * 3000, "one  two   three    "]


def aligned(docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    back |= {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(back.values()))}
    token = {i: bytes(back[c] for c in t) for t, i in tok.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    counts, rows = collections.Counter(), []
    for d, t in docs:
        raw = (" " + (t or "")).encode()
        a, b = (tok.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t, num_threads=1)) if t else ([], [])
        xs, ys = [token[i] for i in a], [piece(i) for i in b]
        if not t or b"".join(xs) != raw or b"".join(ys) != raw:
            rows.append((d, None))
            continue
        ends = lambda z: np.cumsum([len(x) for x in z])
        ea, eb = ends(xs), ends(ys)
        sa, sb = ea - [len(x) for x in xs], eb - [len(x) for x in ys]
        links = [(a[i], b[j]) for i in range(len(a)) for j in np.flatnonzero((sb < ea[i]) & (eb > sa[i]))]
        groups, low = [], 0
        for cut in sorted(set(ea.tolist()) & set(eb.tolist())):
            groups.append(",".join(str(a[i]) for i in np.flatnonzero((sa >= low) & (ea <= cut))) + "|" + ",".join(str(b[j]) for j in np.flatnonzero((sb >= low) & (eb <= cut))))
            low = cut
        counts.update(links)
        rows.append((d, (len(a), len(b), groups, links)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = collections.Counter()
    for d, r in rows:
        out[(d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())] += 1
    return out, counts


@pytest.mark.parametrize("batch_chars", [1, 2000, 1 << 22])
def test_token_alignment(spark, batch_chars):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    rng = random.Random(1)
    wild = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "é", "ß", ".", "'s", "7", " ", "字", "the ", "ing "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = list(enumerate(texts + wild + ODD)) + [(2, texts[2]), (2, texts[2]), (None, "no id here"), (None, None)]
    want, counts = aligned(docs)
    rows = token_alignment.token_alignment(frame(spark, docs), batch_chars=batch_chars).collect()
    assert collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == want
    pairs = token_alignment.pair_counts(token_alignment.align_batches(frame(spark, docs), batch_chars=batch_chars))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts


def test_tokens_never_reach_over_a_cut(monkeypatch):
    real = token_alignment.piece_model

    class Crossing:
        def id_to_piece(self, i):
            return "a▁b"

        def get_piece_size(self):
            return 1

    monkeypatch.setattr(token_alignment, "piece_model", lambda path: (Crossing(), np.array([False])) if path == "crossing" else real(path))
    with pytest.raises(ValueError, match="reaches over"):
        token_alignment.byte_tables(P.path("byte_bpe_50k.json"), "crossing")


def plain_statistics(text):
    """Some of the statistics, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(w), 1)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    chars = max(len(text), 1)
    return {
        "words": np.log1p(len(w)), "word_length": sum(map(len, w)) / n, "distinct_words": len(set(w)) / n**0.5, "commonest_word": max(collections.Counter(w).values(), default=0) / n,
        "repeats_last": sum(a == b for a, b in zip(w, w[1:])) / n, "repeated_triples": sum(c for c in tri.values() if c > 1) / n, "lines": len(text.split("\n")) / n, "symbols": sum(c in "#*$%&|<>" for c in text) / chars,
        "exclaims": text.count("!") / chars, "symbol_words": sum(any(c in "#*$%&|<>" for c in x) for x in w) / n, "one_letter_words": sum(len(x) == 1 for x in w) / n, "spaces": sum(c in " \t\n\x0b\x0c\r" for c in text) / chars,
        "capital_words": sum("A" <= x[0] <= "Z" for x in w) / n, "sentence_ends": sum(x[-1] in ".!?" for x in w) / n, "digits": sum(c in "0123456789" for c in text) / chars,
    }


def test_statistics():
    import pyarrow as pa

    texts = ["", "a a a b\nb a a a", "É ß! THE END. x|y ## 12\n\n12", " \t\n", "one two three one two three one two three", "word " * 300000, "é" * 5]
    got = quality_trees.statistics(pa.array(texts))
    for row, text in zip(got, texts):
        if text:
            for name, value in plain_statistics(text).items():
                assert row[quality_trees.STATISTICS.index(name)] == pytest.approx(value, rel=1e-5, abs=1e-6), (name, text[:20])
        else:
            assert not row.any()


def test_trees_as_arrays_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    x[:, 4] = np.round(x[:, 4])
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] >= 1)).astype(float)
    trees = quality_trees.boost(x, y, trees=20, depth=3)
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.98

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] + (row[trees.feature[node]] > trees.threshold[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:100]], trees.scores(x[:100]))


def brute_split(x, g, h):
    """The best gain over all features and cuts."""
    best = -np.inf
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_trees.PENALTY)
    for k in range(x.shape[1]):
        for c in np.unique(x[:, k])[:-1]:
            m = x[:, k] <= c
            if min(h[m].sum(), h[~m].sum()) >= quality_trees.LEAST_WEIGHT:
                best = max(best, gain(m) + gain(~m) - gain(m | True))
    return best


def test_histogram_splits_equal_all_cuts():
    rng = np.random.default_rng(6)
    bins, g, h = rng.integers(0, 12, (300, 4)), rng.normal(size=300), rng.uniform(0.1, 0.3, 300)
    node = rng.integers(0, 3, 300)
    gain = quality_trees._best_splits(bins, node, 3, g, h)[0]
    for k in range(3):
        assert gain[k] == pytest.approx(brute_split(bins[node == k], g[node == k], h[node == k]))


def test_quality_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.97
    assert np.mean([r.predicted for r in held if r.quality]) >= 0.98


def test_quality_classifier_learns_from_nothing_else(spark):
    """Held-out labels, other columns and ids change no score; null ids, repeats and one-sided labels have defined results."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_trees.fit(docs, labels)
    turned = labels.withColumn("quality", F.when(quality_trees.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality_trees.fit(docs.withColumn("lang", F.lit("x")), turned.unionByName(spark.createDataFrame([(None, 1, 0), (5, 7, 0), (6, None, 0)], labels.schema)))
    assert np.array_equal(model.value, other.value) and np.array_equal(model.threshold, other.threshold)
    few = frame(spark, [(1, None), (1, ""), (None, "A b."), (2, "A b."), (2, "A b.")])
    rows = quality_trees.quality_scores(few, model).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 2 and all(0 <= r.score <= 1 for r in rows)
    good = quality_trees.fit(docs, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality_trees.quality_scores(few, good).collect())
