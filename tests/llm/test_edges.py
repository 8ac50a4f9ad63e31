"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns, missing and conflicting labels: of every operator and stage."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagesieve.llm import cws, gif, linededup, mixing, neardup, packing, passages, quality, secretscan, tokencount, toxicity

from .test_operators import DOCS, ODD, TOK, bits_decode, frame

PIECES, BYTES = f"{TOK}/piece_bpe_32k.model", f"{TOK}/byte_bpe_50k.tiktoken"
#: Names that operators use for columns of their own.
CLASH = ["digest", "bucket", "tokens", "score", "kept", "row", "start", "end", "frames", "copies", "length", "_copy"]
WORDS = ["stone", "river", "green", "makes", "away", "of", "the", "light", "under", "seven"]


def labels_of(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, toxic int, quality int")


def some_labels(spark, n=8):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)] + [(None, 1, 1), (3, 0, None), (3, 1, 1), (10**6, 1, 0)], "doc_id long, toxic int, quality int")


def odd(spark):
    """Odd texts, twice each row, some without an id, and columns whose names clash."""
    df = frame(spark, [*ODD, "Gabc " * 40, None, "tie", "tie"], [*range(len(ODD)), None, None, 20, 20])
    df = df.unionAll(df.where("doc_id = 5"))
    return df.select("*", *(F.lit("own").alias(c) for c in CLASH if c not in df.columns))


OPERATORS = {
    "near duplicates": lambda d, lab: neardup.near_duplicates(d, shingle_words=4),
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.train(d, lab)),
    "packing": lambda d, lab: packing.packed(d, buckets=3, budget=64),
    "mixing": lambda d, lab: mixing.rates(d, lab),
    "token counts": lambda d, lab: tokencount.token_counts(d, PIECES),
    "secrets": lambda d, lab: secretscan.scan(d, BYTES),
    "quality": lambda d, lab: quality.score(d, lab),
    "media": lambda d, lab: gif.media_digests(d),
    "stored media": lambda d, lab: gif.stored_texts(d),
    "fingerprints": lambda d, lab: cws.fingerprints(d),
    "edits": lambda d, lab: cws.compared_with_edits(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    df, run = odd(spark), OPERATORS[name]
    out = run(df, some_labels(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in df.collect())
    # repeated rows get equal results, apart from what depends on the next document or the place in a batch
    if name not in ("edits", "packing"):
        assert len({str(r) for r in out if r.doc_id == 5}) == 1
    assert run(df.limit(0), no_labels(spark)).count() == 0
    assert run(df, no_labels(spark)).count() == len(out)


def test_repeats_of_odd_rows(spark):
    df = odd(spark)
    assert {r.doc_id for r in linededup.repeated_units(df, min_words=1).collect()} >= {4, 9}
    assert linededup.repeated_units(df.limit(0)).count() == 0
    assert passages.repeated_passages(df, words=10).where("doc_id = 5").count() == 0
    # a long text of one word repeats itself after its first run
    assert [(r.start, r.keep_start) for r in passages.repeated_passages(df.where("doc_id = 7"), words=10).collect()] == [(50, 0)]
    clean = passages.without_passages(frame(spark, ["a b c d e f g h i j k", "x a b c d e f g h i j k y"]), words=10).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["a b c d e f g h i j k", "x  y"] and [(s.start, s.end) for s in clean[1].removed] == [(2, 23)]


def test_long_lines_and_passages(spark):
    rng = random.Random(4)
    line = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(20000))
    df = frame(spark, [line + "\nshort one\n" + line, line])
    got = sorted((r.doc_id, r.start) for r in linededup.repeated_units(df).collect())
    assert got == [(0, len(line) + 11), (1, 0)]
    assert sorted((r.doc_id, r.start, r.end) for r in passages.repeated_passages(df).collect()) == [(0, len(line) + 11, 2 * len(line) + 11), (1, 0, len(line))]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage, tmp_path):
    f = dict(corpus_pipeline.STAGES)[stage]
    some_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    df = odd(spark)
    out = f(spark, df, str(tmp_path))
    if stage != "packing":
        assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = out.collect()
    if stage == "secrets":
        assert len(rows) == df.count()
    if stage == "near duplicates":
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [0, 1, 2, 3, 5, 6, 7, 8, 20, None, None]))
    empty = f(spark, df.limit(0), str(tmp_path))
    assert empty.columns == out.columns and empty.count() == 0


def test_stages_are_the_operators(spark, tmp_path):
    """Each stage against a plain computation of what should stay."""
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(60))
    texts = [good() if i % 3 else "%%% $$$ " * 30 for i in range(90)]
    key = "u8Kq2ZpX0vLm9TnR4wYs7B"
    texts[1] += f" {key}"
    texts[4] = texts[2] + " more"
    docs = frame(spark, texts).drop("kept", "component_id", "score")
    labels_of(spark, [(i, int(bool(i % 3))) for i in range(90)], "quality").write.parquet(f"{tmp_path}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality"](spark, docs, str(tmp_path))
    ids = sorted(r.doc_id for r in kept.collect())
    assert [i for i in ids if i % 3 == 0] == [] and len(ids) >= 59
    rest = sorted(r.doc_id for r in steps["near duplicates"](spark, kept, str(tmp_path)).collect())
    assert rest == [i for i in ids if i != 4]
    clean = {r.doc_id: r for r in steps["secrets"](spark, docs.where("doc_id in (1, 2)"), str(tmp_path)).collect()}
    assert clean[1].text == texts[1].replace(key, "[secret]") and clean[2].text == texts[2]
    assert clean[1].n_chars == len(clean[1].text)


# --- against plain computations ----------------------------------------------------------------------------------


def test_toxicity_scores_from_plain_compressions(spark):
    """Features and scores of a fitted model, word by word with a compressor of our own."""
    import zstandard as z

    rng = random.Random(2)
    rows = [" ".join(rng.choice(WORDS) for _ in range(30)) + (" moronic scumbag" if i % 4 == 0 else "") for i in range(300)]
    docs, known = frame(spark, [*rows, ""]), labels_of(spark, [(i, int(i % 4 == 0)) for i in range(300)], "toxic")
    model = toxicity.train(docs, known)
    params = z.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=5, target_length=24, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    begin, end = b"\x01<|window|>\x02", b"\x01\x02\x03\x04\x05\x06\x07\x08"

    def size(word, content):
        d = z.ZstdCompressionDict(content + begin, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return len(z.ZstdCompressor(dict_data=d, compression_params=params).compress(begin + b" " + word + b" " + end))

    def score(text):
        words = set(re.sub("[^a-z]", " ", text.lower()).encode().split())
        gains = sorted((size(w, model.ordinary) - size(w, model.toxic) for w in words), reverse=True)
        gains = [g for g in gains if g > 0]
        top = [*gains[:2], 0, 0][:2]
        x = [top[0], top[1], math.log1p(sum(g for g in gains if g >= 3)), math.log1p(len(words))]
        logit = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True)) + model.bias
        return 1 / (1 + math.exp(-max(-30, min(30, logit))))

    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate([*rows, ""]):
        assert abs(got[i].score - score(t)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)


def test_conflicting_labels_count_as_toxic(spark):
    docs = frame(spark, ["a b", "c d"], [0, 4])
    known = spark.createDataFrame([(0, 0), (0, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, known, "toxic", 5, 5) == [(0, "a b", 1)]


def test_mixing_equals_a_gradient_in_numpy(spark):
    texts = ["the the and with this"] * 30 + ["für über größe schön"] * 10 + ["été où garçon"] * 5 + ["", "x"]
    rows = [(i, t, "en" if i < 30 else "de" if i < 40 else "fr", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"de": 0.5, "en": 0.2, "fr": 0.3}
    model, _ = mixing.fit(docs, docs.where("doc_id < 45").select("doc_id"), weights=weights)
    domains, letters = ["de", "en", "fr"], list(mixing.LETTERS)
    counts = np.array([[t.count(c) for c in letters] + [len(t) - sum(t.count(c) for c in letters)] for t in texts], float)
    lang = np.array([r[2] for r in rows])
    prior = np.array([np.mean(lang[:45] == d) for d in domains])
    sums = np.array([counts[:45][lang[:45] == d].sum(0) for d in domains]) + 0.5
    logs = np.log(sums / sums.sum(1, keepdims=True))
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    post = np.log(prior) + 60 * share @ logs.T
    post = np.exp(post - post.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    tokens = np.array([len(t.split()) for t in texts], float)
    rate, now = np.ones(len(texts)), tokens @ post
    aim, scale = np.array([weights[d] for d in domains]) * tokens.sum(), now.copy()
    for _ in range(200):
        if np.all(np.abs(now - aim) <= 1e-3 * np.maximum(aim, 0.01 * tokens.sum())):
            break
        rate = np.maximum(0, rate - post @ ((now - aim) / scale))
        now = (tokens * rate) @ post
    got = {r.doc_id: r for r in mixing.rates(docs, docs.where("doc_id < 45").select("doc_id"), weights=weights).collect()}
    assert np.allclose([got[i].rate for i in range(len(texts))], rate, atol=1e-9) and model.missed < 2e-3
    assert np.allclose(model.reached, now)


def test_mixing_of_many_domains(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijk"[k : k + 4]) for _ in range(30)) for k in range(6) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, f"d{i // 8}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    one = mixing.rates(docs, docs.select("doc_id")).orderBy("doc_id").collect()
    monkeypatch.setattr(mixing, "UNROLLED", 3)
    many = mixing.rates(docs, docs.select("doc_id")).orderBy("doc_id").collect()
    assert np.allclose([r.rate for r in one], [r.rate for r in many], atol=1e-6)
    assert [(r.domain, r.posteriors, r.copies) for r in one] == [(r.domain, r.posteriors, r.copies) for r in many]


def test_packing_equals_a_plain_deal(spark):
    rng = random.Random(9)
    texts = ["w " * rng.choice([0, 1, 2, 5, 5, 5, 9, 40]) for _ in range(300)]
    rows = packing.packed(frame(spark, texts), buckets=3, budget=20).collect()
    bounds = packing.optimal_bounds(*np.unique([len(t.split()) for t in texts], return_counts=True), 3)
    assert sorted({r.bound for r in rows}) == bounds
    for k, bound in enumerate(bounds):
        mine = [r for r in rows if r.bucket == k]
        assert all(r.length == len(texts[r.doc_id].split()) and r.bound == min(b for b in bounds if b >= r.length) for r in mine)
        each = max(1, 20 // max(bound, 1))
        # places of a bucket are those of one list, cut every so many rows
        assert sorted(r.batch * each + r.place for r in mine) == list(range(len(mine)))


@pytest.mark.parametrize("fallback", [False, True])
def test_token_counts_of_whole_texts(fallback):
    from tokenizers import models

    vocab = tokencount.zipf_vocabulary(PIECES)
    table = [("<unk>", -30.0), *vocab.items()]
    if fallback:
        table += [(f"<0x{i:02X}>", -30.0) for i in range(256)]
    library = models.Unigram(table, 0, fallback)
    count = lambda text: len(library.tokenize(tokencount.BLANK + text.replace(" ", tokencount.BLANK))) if text else 0
    own = tokencount.UnigramCounter(vocab, byte_fallback=fallback)
    own.unknown = min(v for _, v in table) - 10
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice("the ran oiäöß 日本🎉zq9.  ") for _ in range(rng.randint(1, 200))).strip()
        assert own.count(text) == count(text), text
    assert own.count("the  cat " * 3000 + "end") == count("the  cat " * 3000 + "end")


def test_pieces_across_words_count():
    vocab = {"▁": -1.0, "a": -2.0, "b": -2.0, "▁a": -1.5, "▁a▁b": -1.6}
    split, whole = tokencount.UnigramCounter(vocab), tokencount.UnigramCounter(vocab, split_words=False)
    assert (split.count("a b"), whole.count("a b"), whole.count("a a b"), whole.count("")) == (3, 1, 2, 0)


def plain_base_spans(text):
    """The base rules, scanned sign by sign."""
    word, value = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    out = []

    def assign(i):
        low = text[i : i + 8].lower()
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name) and all(c in word + "_" for c in text[i : i + len(name)]):
                j = i + len(name)
                for skip in ("\"'", " ", ":=", " ", "\"'"):
                    if skip == ":=":
                        if text[j : j + 1] not in (":", "=") or not text[j : j + 1]:
                            break
                        j += 1
                    elif skip == " ":
                        while text[j : j + 1] == " ":
                            j += 1
                    elif text[j : j + 1] and text[j] in skip:
                        j += 1
                else:
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        return j, k
        return None

    i = 0
    while i < len(text):
        hit = assign(i)
        if hit:
            if hit[1] - hit[0] >= 6:
                out.append((i, 0, hit[1]))
            i = hit[1]
        else:
            i += 1
    for kind, begin, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            k = i + len(begin)
            if text.startswith(begin, i):
                while k < len(text) and text[k] in chars:
                    k += 1
            if text.startswith(begin, i) and k > i + len(begin):
                if k - i >= least:
                    out.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(out)


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(1)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", "  ", "\"", "'", "abc123", "x", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", ".", "/", "é", "\n", "K", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert [tuple(s) for s in secretscan.base_spans(text)] == plain_base_spans(text), text


def test_recall_of_planted_keys(spark):
    """Random keys of 20 characters and more are found; words, digests, identifiers and dates are not."""
    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(chars, k=rng.choice([20, 24, 32, 40, 64]))) for _ in range(400)]
    clean = ["a-long-name-of-words/and/paths_of_code", "2024-01-31", "3F2504E0-4F89-41D3-9A0C-0305E82C3301", hashlib.sha1(b"x").hexdigest().upper(), "internationalisation", "SomeClassNameOfOurs"]
    rows = secretscan.scan(frame(spark, [f"see {k} here" for k in keys] + clean), BYTES).orderBy("doc_id").collect()
    found = sum(r.n_random == 1 for r in rows[: len(keys)])
    assert found >= 0.99 * len(keys) and not any(r.n_random for r in rows[len(keys) :])


def test_quality_equals_numpy(spark):
    """Scores of a fitted model from features computed anew."""
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(60))
    texts = [good() if i % 3 else "%%% $$$ " * 20 + good()[:20] for i in range(200)]
    docs = frame(spark, texts)
    known = labels_of(spark, [(i, int(bool(i % 3))) for i in range(200)], "quality")
    table = quality.feature_table(docs)
    model = quality.train(docs, known, table)
    x = np.array([quality.text_features(t) + quality.meta_features("en", "s", len(t)) for t in texts], np.float32).astype(float)
    want = 1 / (1 + np.exp(-(model.mix[2] + sum(m * np.clip(((x - model.mean) / model.scale)[:, cut] @ w + b, -20, 20) for m, (w, b), cut in zip(model.mix, model.views, (slice(0, quality.N_TEXT), slice(quality.N_TEXT, None)), strict=False)))))
    got = {r.doc_id: r for r in quality.score(docs, known).collect()}
    assert np.allclose([got[i].score for i in range(200)], want, atol=1e-6)
    kept = {r.doc_id for r in quality.good_documents(docs, known).collect()}
    assert kept == {i for i in range(200) if got[i].kept}


# --- GIF ---------------------------------------------------------------------------------------------------------


def plain_gif(data):
    """Indices of each frame of a GIF without extensions but graphic control: a second reader."""
    flags, at, out = data[10], 13, []
    at += 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            columns, rows, local = *struct.unpack_from("<HH", data, at + 5), data[at + 9]
            at += 10 + (3 * (2 << (local & 7)) if local & 0x80 else 0)
            bits, at, stream, start = data[at], at + 1, b"", at + 1
            while data[at]:
                stream += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            at += 1
            assert start
            out.append(bits_decode(stream, bits, rows * columns))
            continue
        while data[at]:
            at += 1 + data[at]
        at += 1
    return out


def test_stored_files_by_a_second_reader(spark):
    texts = [*ODD, "é" * 70000, "".join(chr(random.Random(1).randrange(32, 1000)) for _ in range(3000))]
    df = frame(spark, texts)
    digests = {r.doc_id: r for r in gif.media_digests(df).collect()}
    for r in gif.stored_texts(df).collect():
        data, payload = bytes(r.media), gif.padded(texts[r.doc_id] or "")
        assert b"".join(plain_gif(data)) == payload
        d = digests[r.doc_id]
        assert (d.media_bytes, d.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8).tolist()
        assert d.feature == f"frames={len(r.frames)};duration={4 * len(r.frames)};grey={'/'.join(map(str, grey))}"
        assert [sum(h) for h in zip(*(f.histogram for f in r.frames), strict=True)] == grey
        assert [f.start for f in r.frames] == [4 * k for k in range(len(r.frames))] and r.n_bytes == len((texts[r.doc_id] or "").encode())


def test_decoded_frames(spark):
    pal = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    own = np.array([[10, 20, 30], [255, 255, 255]], np.uint8)
    frames = [
        gif.Frame(np.zeros((2, 2), np.uint8), delay=3, disposal=1),
        gif.Frame(np.array([[1]], np.uint8), delay=2, disposal=3, palette=own),
        gif.Frame(np.array([[2, 3]], np.uint8), top=1, delay=4, disposal=2, transparent=3, interlaced=True),
        gif.Frame(np.array([[1]], np.uint8), left=1),
    ]
    whole = gif.encode(gif.Image(2, 2, pal, 0, frames))
    rows = [("ok", bytearray(whole)), ("cut", bytearray(whole[:-12])), ("none", None), ("text", bytearray(b"hello")), ("head", bytearray(whole[:10])), ("empty", bytearray(b"")), ("junk", bytearray(whole[:40] + b"\x00\x01" + whole[42:]))]
    df = spark.createDataFrame(rows, "name string, media binary").withColumn("frames", F.lit("clash"))
    got = {r.name: r for r in gif.decoded_frames(df).collect()}
    ok = got["ok"].frames
    assert [(f.start, f.delay, f.width, f.height) for f in ok] == [(0, 3, 2, 2), (3, 2, 2, 2), (5, 4, 2, 2), (9, 0, 2, 2)] and got["ok"].error is None
    # four red pixels; one white over them; restored, then one blue; its row cleared to black, then one green
    assert [f.red for f in ok] == [[0] * 7 + [4], [0] * 7 + [4], [1] + [0] * 6 + [3], [3] + [0] * 6 + [1]]
    assert [f.green[7] for f in ok] == [0, 1, 0, 1] and [f.blue[7] for f in ok] == [0, 1, 1, 0]
    assert got["none"].frames is None and got["none"].error is None
    for name in ("text", "head", "empty"):
        assert got[name].frames is None and got[name].error
    assert all((got[n].frames is None) == (got[n].error is not None) for n in ("cut", "junk"))
    assert gif.decoded_frames(df.limit(0)).count() == 0


def test_lzw_by_a_second_decoder():
    rng = np.random.default_rng(3)
    for bits in (2, 4, 8):
        for n in (0, 1, 5, 300, 20000):
            d = rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes()
            assert bits_decode(gif.lzw_encode(d, bits), bits, n) == d
        run = bytes((1,)) * 30000
        assert bits_decode(gif.lzw_encode(run, bits), bits, 30000) == run


def test_fingerprints_of_equal_and_empty_texts(spark):
    out = [r.fingerprint for r in cws.fingerprints(frame(spark, ["a b b", "B a  b", "", None, "c"])).orderBy("doc_id").collect()]
    assert out[0] == out[1] and out[2] == out[3] == "" and len(out[4]) == 4 * cws.SAMPLES


def test_edits_of_shared_ids(spark):
    """An id and the null id with many texts are dealt out over blocks; every row has the next by (id, hash of text)."""
    texts = [f"t{i} " * (i % 9 + 1) for i in range(120)]
    ids = [None] * 40 + [7] * 50 + list(range(8, 38))
    got = cws.compared_with_edits(frame(spark, texts, ids)).collect()
    import xxhash

    order = sorted(range(120), key=lambda i: (ids[i] is not None, ids[i] or 0, xxhash.xxh3_64_intdigest(texts[i].encode()) >> 1, texts[i]))
    want = []
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % 120]]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        want.append((str(ids[i]), len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_line_sql_says_the_same(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}'")
    for words in (1, 8):
        sql = c.execute(linededup.lines_sql(words))
        names = [d[0] for d in sql.description]
        got = sorted(map(tuple, linededup.repeated_units(spark.read.parquet(path), min_words=words).select(*names).collect()))
        assert got == sorted(sql.fetchall()) and got


def test_passage_sql_says_the_same(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}'")
    for words in (8, 50):
        sql = c.execute(passages.passages_sql(words))
        names = [d[0] for d in sql.description]
        got = sorted(map(tuple, passages.repeated_passages(spark.read.parquet(path), words=words).select(*names).collect()))
        assert got == sorted(sql.fetchall()) and got


def test_schema_of_documents():
    assert DOCS.startswith("doc_id long") and zlib.crc32(b"2") % 4 >= 0
