"""Corpus operators against brute force, exact round trips, library results and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import cws, gif, linededup, mixing, neardup, packing, passages, quality, secretscan, tokencount, toxicity

TOK = "/opt/tokenizers"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, score double"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), None, "x", None) for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " \n", "a", "a", "one two three", "x" * 30000, "word " * 30000, "same text of six words here", "same text of six words here"]


def brute(rows, size=4):
    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)]
    texts = list(ODD)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, texts), shingle_words=4).collect()}
    want = brute(list(enumerate(texts)))
    assert got == {i: (c, i == c) for i, c in want.items()}


def test_near_duplicates_null_ids_and_repeated_rows(spark):
    df = frame(spark, ["a b c d e", "a b c d e", "a b c d e", "q"], [7, 7, None, None])
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df).collect())
    assert rows == [(-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True)]
    assert neardup.one_per_class(df).where("doc_id = 7").count() == 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(60)]
        toxic = rng.random() < 0.2
        if toxic:
            for x in rng.sample(["moronic", "scumbag", "idiots"], 2):
                w[rng.randrange(60)] = x
        rows.append(" ".join(w))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, [*rows, *ODD]), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert len(scored) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in scored.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(scored[i].held_out for i, _ in held)
    assert sum(scored[i].predicted == y for i, y in held) / len(held) > 0.95


def test_toxicity_forgets_no_word_of_a_text(monkeypatch):
    rng = random.Random(3)
    words = ["moronic", "scumbag", *(f"{rng.choice(['stone', 'river'])}{''.join(rng.choices('abcdef', k=3))}" for _ in range(60))]
    texts = [" ".join(rng.sample(words, 12)) for _ in range(40)] + [" ".join(words)]
    pair = b"moronic scumbag".rjust(64, b"\x03"), b"stone river".rjust(64, b"\x03")
    want = [toxicity.Windows(*pair).features(t) for t in texts]
    monkeypatch.setattr(toxicity, "_REMEMBERED", 16)
    small = toxicity.Windows(*pair)
    assert [small.features(t) for t in texts] == want and max(w[0] for w in want) > 0 and len(small.known) <= 16


@pytest.mark.parametrize("fallback", [False, True])
def test_token_counts_equal_the_library(fallback):
    from tokenizers import models

    vocab = tokencount.zipf_vocabulary(f"{TOK}/piece_bpe_32k.model")
    table = [("<unk>", -30.0), *vocab.items()]
    if fallback:
        table += [(f"<0x{i:02X}>", -30.0) for i in range(256)]
    library = models.Unigram(table, 0, fallback)
    own = tokencount.UnigramCounter(dict(table[1 : 1 + len(vocab)]), byte_fallback=fallback)
    own.unknown = min(v for _, v in table) - 10
    rng = random.Random(2)
    for _ in range(400):
        s = tokencount.BLANK + "".join(rng.choice("theranoiäöß日本🎉zq9.") for _ in range(rng.randint(1, 14)))
        assert own.chunk(s) == len(library.tokenize(s)), s


def test_token_counts_of_odd_texts(spark):
    rows = {r.doc_id: r.n_tokens for r in tokencount.token_counts(frame(spark, ODD), f"{TOK}/piece_bpe_32k.model").collect()}
    assert rows[0] == rows[1] == 0 and rows[3] == rows[4] and rows[7] > 30000 - 1


def test_secret_spans(spark):
    key, hexed = "AKIA" + "ABCD1234" * 2, "0123456789abcdef" * 2
    text = f"Api_Key = '{hexed[:20]}xyz' é {key} {hexed} secret:token : abcdefgh pass u8Kq2ZpX0vLm9TnR4wYs7B"
    base = secretscan.base_spans(text)
    assert [(secretscan.KINDS[s.kind], text[s.start : s.end]) for s in base] == [("assign", f"Api_Key = '{hexed[:20]}xyz"), ("access", key), ("hex", hexed)]
    got = secretscan.scan(frame(spark, [text, *ODD]), f"{TOK}/byte_bpe_50k.tiktoken").orderBy("doc_id").collect()
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex, got[0].n_random) == (1, 1, 1, 1)
    assert got[0].base_sha256 == hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = secretscan.redacted(frame(spark, [text, None]), f"{TOK}/byte_bpe_50k.tiktoken").orderBy("doc_id").collect()
    assert key not in clean[0].text and hexed not in clean[0].text and clean[1].text is None


def test_gif_round_trips():
    rng = np.random.default_rng(0)
    for bits in (2, 5, 8):
        for n in (0, 1, 300, 60000):
            d = rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(d, bits), bits, n) == d
    for t in ["", "é" * 500, "long line " * 9000]:
        p = gif.padded(t)
        assert gif.read_back(gif.store(p))[0] == p


def bits_decode(stream, bits, most):
    """GIF LZW read code by code, bit by bit: a plain second decoder."""
    number, table, out, at, width = int.from_bytes(stream, "little"), {}, b"", 0, bits + 1
    clear, end, last = 1 << bits, (1 << bits) + 1, None
    while at + width <= 8 * len(stream):
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, last = {i: bytes((i,)) for i in range(clear)}, bits + 1, None
            size = end + 1
            continue
        if code == end:
            break
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and size < 4096:
            table[size] = last + entry[:1]
            size += 1
        if size == 1 << width and width < 12:
            width += 1
        last = entry
    return out[:most]



def test_gif_disposal_and_transparency():
    red, pal = np.zeros((2, 2), np.uint8), np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    spot = np.array([[1]], np.uint8)
    frames = [gif.Frame(red, delay=3, disposal=1), gif.Frame(spot, delay=2, disposal=3), gif.Frame(np.array([[2, 3]], np.uint8), top=1, disposal=2, transparent=3, interlaced=True), gif.Frame(spot, left=1)]
    out = gif.decode(gif.encode(gif.Image(2, 2, pal, 0, frames)))
    assert [s for s, _, _ in out] == [0, 3, 5, 5]
    assert out[1][2][0, 0].tolist() == [0, 255, 0] and out[2][2][0, 0].tolist() == [255, 0, 0]
    assert out[2][2][1].tolist() == [[0, 0, 255], [255, 0, 0]] and out[3][2][1].tolist() == [[0, 0, 0], [0, 0, 0]]
    assert gif.histogram(out).shape == (4, 3, 8)


def test_media_digests(spark):
    for r in gif.media_digests(frame(spark, ODD)).collect():
        p = gif.padded(ODD[r.doc_id] or "")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_line_dedup(spark):
    texts = ["keep me once please\nother", "Keep  me once please\nkeep me once please\nnew line of four", None, ""]
    df = frame(spark, texts).withColumn("removed", F.lit(1))
    rows = sorted((r.doc_id, r.start, r.end, r.keep_doc_id) for r in linededup.repeated_units(df, min_words=3).collect())
    assert rows == [(1, 0, 20, 0), (1, 21, 40, 0)]
    clean = {r.doc_id: r.text for r in linededup.without_repeats(df, min_words=3).collect()}
    assert clean == {0: texts[0], 1: "new line of four", 2: None, 3: ""}


def passages_brute(rows, size):
    """Words to remove by (row, word): all runs of size words that stand earlier by (doc_id, start), not overlapping the place that stays."""
    at, gone = {}, []
    for i, text in rows:
        words = list(re.finditer(r"\S+", text or ""))
        for k in range(len(words) - size + 1):
            run = tuple(m[0].lower() for m in words[k : k + size])
            keep = at.setdefault(run, (i, k))
            if keep != (i, k) and (keep[0] != i or k >= keep[1] + size):
                gone += [(i, x) for x in range(words[k].start(), words[k + size - 1].end())]
    return set(gone)


def test_passages_inside_lines_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"W{rng.randrange(10**6)}"
    passage = [word() for _ in range(30)]
    texts = [*ODD, "a b " * 40, " ".join(word() for _ in range(40))]
    for _ in range(25):
        s = rng.randrange(0, 12)
        part = passage[s : s + rng.randrange(8, 19)]
        texts.append(" ".join(word() for _ in range(rng.randrange(20))) + " é " + rng.choice([" ", "\n", "  "]).join(part).lower() + " " + " ".join(word() for _ in range(rng.randrange(20))))
    texts += [texts[-1], texts[-2] + " more", "İ x " + texts[-3] + "\n\n" + texts[-3]]
    want = passages_brute([(i, t) for i, t in enumerate(texts) if i not in (6, 7)], 10)
    got = passages.repeated_passages(frame(spark, [t if i not in (6, 7) else "" for i, t in enumerate(texts)]), words=10).collect()
    spans = sorted((r.doc_id, r.start, r.end) for r in got)
    assert {(i, x) for i, s, e in spans for x in range(s, e)} == want and want
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    again = passages.repeated_passages(frame(spark, ["q " + " ".join(passage), " ".join(passage) + " r"], [None, 4]), words=10).collect()
    assert [(r.doc_id, r.start, r.keep_doc_id, r.keep_start) for r in again] == [(None, 2, 4, 0)]
    assert passages.repeated_passages(frame(spark, ["x"]).limit(0)).count() == 0


def test_fingerprints_follow_generalised_jaccard():
    s, rng = cws.Sampler(2048), random.Random(1)
    for _ in range(5):
        a, b = ({f"w{i}".encode(): rng.randint(1, 9) for i in rng.sample(range(30), 20)} for _ in range(2))
        keys = set(a) | set(b)
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        assert abs(cws.likeness(s.fingerprint(a), s.fingerprint(b)) - want) < 0.05


def test_edits_against_brute_force(spark):
    ids = [5, 1, 9, 3, 7, 11, 13, 15, 17, 19]
    got = {r.doc_id: r for r in cws.compared_with_edits(frame(spark, ODD, ids)).collect()}
    rows = sorted(zip(ids, [t or "" for t in ODD], strict=True))
    s = cws.Sampler()
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        f, g, h = s.fingerprints([cws.terms(x) for x in (t, e, n)])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) == (len(t), hashlib.sha256(e.encode()).hexdigest(), cws.hexed(f), cws.likeness(f, g), cws.likeness(f, h))
    assert cws.compared_with_edits(frame(spark, ["x"]).limit(0)).count() == 0


def test_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(4)
    lengths, counts = np.arange(1, 10) * 3, rng.integers(1, 50, 9)
    cost = lambda bounds: sum(n * min(b for b in bounds if b >= x) for x, n in zip(lengths, counts, strict=True))
    best = min(cost([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
    assert cost(packing.optimal_bounds(lengths, counts, 3)) == best


def test_packing_fills_batches(spark):
    rows = packing.packed(frame(spark, ODD), buckets=3, budget=64).collect()
    assert len(rows) == len(ODD) and all(r.length <= r.bound for r in rows)
    seen = {}
    for r in rows:
        seen.setdefault((r.bucket, r.batch), []).append(r)
    assert all(len(b) <= max(1, 64 // max(b[0].bound, 1)) and sorted(r.place for r in b) == list(range(len(b))) for b in seen.values())
    assert packing.packed(frame(spark, ["x"]).limit(0)).count() == 0


def test_mixing_reaches_targets(spark):
    texts = ["the the and with this"] * 30 + ["für über größe schön"] * 10 + ODD
    rows = [(i, t, "de" if 30 <= i < 40 else "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model, _ = mixing.fit(docs, docs.where("doc_id < 40").select("doc_id"), weights={"de": 0.5, "en": 0.5})
    assert np.allclose(model.reached, model.targets, rtol=0.05)
    out = mixing.rates(docs, docs.select("doc_id"), weights={"de": 0.5, "en": 0.5}).collect()
    assert len(out) == len(rows) and all(r.rate >= 0 for r in out)
    assert mixing.mixed(docs, docs.select("doc_id")).columns == docs.columns


def test_quality_on_junk(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["stone", "river", "of", "green", "makes", "away"]) + str(rng.randint(0, 9)) for _ in range(80))
    rows = [good() if i % 3 else "%%% $$$ " * 20 + good()[:20] for i in range(400)]
    docs = frame(spark, [*rows, *ODD])
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].kept == bool(i % 3) for i in held) / len(held) > 0.97
    assert len(got) == len(rows) + len(ODD)


def test_quality_candidates_and_handing_over(spark):
    vectors = [[float(i % 7)] * (quality.N_TEXT + quality.N_META) for i in range(40)]
    rows = [(i if i < 38 else None, x) for i, x in enumerate(vectors)] + [(100, [50.0] * 40), (101, [60.0] * 40)]
    table = spark.createDataFrame(rows, "doc_id long, x array<float>")
    labels = spark.createDataFrame([(100, 1), (101, None), *((i, i % 2) for i in range(0, 40, 7))], "doc_id long, quality int")
    free = quality.candidates(table, labels)
    # only labelled documents are left out, in all four parts by hash, and equal vectors count once
    assert sorted(r.x[0] for r in free.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 60.0]
    many = spark.createDataFrame([([float(i)] * 40,) for i in range(-5000, 5000)], "x array<float>")
    mean, scale = np.zeros(40), np.full(40, 100.0)
    fitted = {"t": (np.ones(13), 0.0), "m": (np.zeros(27), 0.0)}
    handed = {"t": [], "m": []}
    z = np.arange(-5000, 5000)[:, None] * np.ones(40) / 100
    for part in (500, 450):
        before = quality._given(z, "t", handed["t"])
        cuts = quality._cuts(many, mean, scale, fitted, handed, 0.05, 0.95)
        for v in "tm":
            handed[v].append((*fitted[v], *cuts[v]))
        new = quality._given(z, "t", handed["t"])[np.isnan(before)]
        assert abs((new == 1).sum() - part) < 5 and abs((new == 0).sum() - part) < 5
        assert np.isnan(quality._given(z, "m", handed["m"])).all()
    y = np.array([0.0, 1.0, 1.0, 0.0])
    seed = np.vstack([z[[10, 9990]], z[[6000, 4000]]])
    got = quality._refitted(many, mean, scale, seed, y, fitted, handed, 2.0)
    label = quality._given(z, "t", handed["t"])
    has = ~np.isnan(label)
    w, b = quality._logistic(np.r_[seed, z[has]][:, 13:], np.r_[y, label[has]], ridge=2.0)
    assert np.allclose(got["m"][0], w, atol=1e-4) and abs(got["m"][1] - b) < 1e-4
    # a start far from the optimum must not run away
    far = {"t": (np.full(13, 4.0), 0.0), "m": (np.full(27, -3.0), 5.0)}
    again = quality._refitted(many, mean, scale, seed, y, far, handed, 2.0)
    assert np.allclose(again["m"][0], got["m"][0], atol=1e-3)


def test_packing_is_optimal_for_many_lengths(spark):
    rng = np.random.default_rng(6)
    lengths = np.cumsum(rng.integers(1, 9, 3000)) + 1000
    counts = rng.integers(1, 50, 3000)
    bounds = packing.optimal_bounds(lengths, counts, 4)
    # brute force, row by row
    total = np.concatenate([[0], np.cumsum(counts)])
    cost = total[1:] * lengths
    for _ in range(3):
        cost = np.array([min(total[j + 1] * lengths[j], (cost[:j] + (total[j + 1] - total[1 : j + 1]) * lengths[j]).min(initial=1 << 62)) for j in range(3000)])
    at = np.searchsorted(bounds, lengths)
    assert int((counts * np.array(bounds)[at]).sum()) == cost[-1]
    docs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, text long")
    rows = packing.packed(docs, buckets=4, length=F.col("text")).collect()
    assert max(r.bound for r in rows) == lengths[-1]
    assert sorted({r.bound for r in rows}) == packing.optimal_bounds(lengths, np.ones(3000, int), 4)


def test_keys_behind_paths_and_around_base_spans(spark):
    rng = random.Random(12)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    path = "/production/database/connection/credentials/"
    keys = ["".join(rng.choices(chars, k=n)) for n in (20, 24, 32) for _ in range(50)]
    part = "u8Kq2ZpX0vLm9TnR4wYs7B"
    plain = ["/usr/share/doc/packages/readme/index", "id/3F2504E0-4F89-41D3-9A0C-0305E82C3301", "objects/" + "0123456789ABCDEF" * 2]
    texts = [path + k for k in keys] + [part + "/" + "0123456789abcdef" * 2] + plain
    clean = [r.text for r in secretscan.redacted(frame(spark, texts), f"{TOK}/byte_bpe_50k.tiktoken").orderBy("doc_id").collect()]
    assert not any(k in t for k, t in zip(keys, clean, strict=False))
    assert part not in clean[len(keys)] and clean[-3:] == plain


def test_one_per_class_with_repeated_ids(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    def left(rows):
        texts, ids = [t for _, t in rows], [i for i, _ in rows]
        return sorted((r.doc_id or -1, r.text) for r in neardup.one_per_class(frame(spark, texts, ids)).collect())

    # a copy of 3 goes although its id has another text, and what stays does not depend on other documents
    assert left([(3, a), (7, b), (7, a)]) == [(3, a), (7, b)]
    assert left([(3, a), (7, b), (7, a), (9, "x y z"), (9, "x y z"), (7, b)]) == [(3, a), (7, b), (9, "x y z")]
    # without an id a text stays once, and not beside an equal one with an id
    assert left([(None, a), (None, a), (None, b), (7, b)]) == [(-1, a), (7, b)]
    assert left([(1, ""), (2, ""), (2, ""), (None, None)]) == [(-1, None), (1, ""), (2, "")]


def test_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK_ROWS", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(4, 9)):
            w[rng.randrange(100)] = rng.choice("abcdefgh")
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), shingle_words=4).collect()}
    assert got == brute(list(enumerate(texts)))
