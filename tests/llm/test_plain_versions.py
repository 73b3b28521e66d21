"""Operators without SQL against plain versions: licences, GIF, tokens and offsets, severity, quality ratio."""

import collections
import hashlib
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltbed.llm import bpe, gif, licenses, ngram_lm, quality, queries, textarrays, toxicity

from ..conftest import SF
from .test_text_operators import LIBRARY, PATH, WORD, brute_lm

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


# ---- op9

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tree_of(template):
    """Nested lists: a word, ('any', n) or ('may', list)."""
    stack = [[]]
    for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            inner = stack.pop()
            stack[-1].append(("may", inner))
        elif part.startswith("{{"):
            stack[-1].append(("any", int(part[2:-2])))
        else:
            stack[-1] += LICENSE_WORD.findall(part.translate(LOW))
    return stack[0]


def ends_of(nodes, words, starts):
    for node in nodes:
        if isinstance(node, str):
            starts = {i + 1 for i in starts if i < len(words) and words[i] == node}
        elif node[0] == "any":
            starts = {i + k for i in starts for k in range(1, node[1] + 1) if i + k <= len(words)}
        else:
            starts |= ends_of(node[1], words, starts)
        if not starts:
            return starts
    return starts


def plain_scan(text, base, templates):
    words = LICENSE_WORD.findall((text or "").translate(LOW))
    labels, covered, places = set(), set(), []
    for phrase, label in base.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
                covered |= set(range(i, i + len(p)))
    trees = {k: tree_of(v) for k, v in templates.items()}
    for label, nodes in trees.items():
        for i in range(len(words)):
            if ends := ends_of(nodes, words, {i}):
                labels.add(label)
                covered |= set(range(i, max(ends)))
    return ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0


def filled(template, r):
    """A text that the template accepts, some options left out, punctuation and case changed."""
    def walk(nodes):
        for n in nodes:
            if isinstance(n, str):
                yield n.upper() if r.random() < 0.2 else n
            elif n[0] == "any":
                yield from (r.choice(["acme", "inc", "2020", "the"]) for _ in range(r.randrange(1, n[1] + 1)))
            elif r.random() < 0.6:
                yield from walk(n[1])

    return "".join(w + r.choice([" ", ", ", "\n * ", " - "]) for w in walk(tree_of(template)))


def test_labels_and_scores_equal_a_plain_matcher(spark):
    r = random.Random(9)
    given = dict(list(texts(spark).items())[:60])
    for i, (label, template) in enumerate(licenses.TEMPLATES.items()):
        for j in range(3):
            whole = filled(template, r)
            given[10**6 + 10 * i + j] = "Some words. " + whole + " and more."
            cut = whole.split()
            del cut[r.randrange(len(cut))]
            given[10**7 + 10 * i + j] = " ".join(cut)
    given[-1], given[-2] = None, "  "
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, given.items())).collect()}
    seen = set()
    for i, text in given.items():
        labels, score = plain_scan(text, licenses.BASE, licenses.TEMPLATES)
        assert got[i].labels == labels and got[i].score == pytest.approx(score), (i, text)
        if 10**6 <= i < 10**7:
            own = list(licenses.TEMPLATES)[(i - 10**6) // 10]
            assert own in labels
            seen.add(own)
    assert seen == set(licenses.TEMPLATES)


def test_a_template_may_begin_with_any_words(spark):
    templates = {"x": "{{2}} license grants rights", "y": "[[the]] {{1}} [[big]] end", "z": "[[{{3}}]] only"}
    given = {1: "the acme license grants rights", 2: "license grants rights", 3: "a license grants rights", 4: "the big big end", 5: "one two three four only", 6: "end"}
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, given.items()), templates=templates).collect()}
    for i, text in given.items():
        assert (got[i].labels, got[i].score) == plain_scan(text, licenses.BASE, templates)
    assert got[1].labels == "x" and got[2].labels == "" and got[5].labels == "z"


# ---- op5


def textbook_gif(data):
    """(samples of the frames joined, delays), by a table of strings and a bit at a time."""
    assert data[:6] == b"GIF89a"
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, out, delays = 13, bytearray(), []
    palette = data[at : at + 3 * (2 << (flags & 7))]
    at += len(palette)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delays.append(10 * struct.unpack_from("<H", data, at + 4)[0])
            at += 2
        else:
            assert data[at] == 0x2C
            size = struct.unpack_from("<HH", data, at + 5)
            at += 10
            least, stream = data[at], b""
            at += 1
            while data[at]:
                stream += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            at += 1
            number, n_bits = int.from_bytes(stream, "little"), 0
            clear = 1 << least
            table, bits, before, pixels = {}, least + 1, None, bytearray()
            while True:
                code, n_bits = number >> n_bits & ((1 << bits) - 1), n_bits + bits
                if code == clear:
                    table, bits, before = {i: bytes([i]) for i in range(clear)}, least + 1, None
                    following = clear + 2
                    continue
                if code == clear + 1:
                    break
                entry = table[code] if code in table else before + before[:1]
                pixels += entry
                if before is not None and following < 4096:
                    table[following] = before + entry[:1]
                    following += 1
                    if following == 1 << bits and bits < 12:
                        bits += 1
                before = entry
            assert len(pixels) == size[0] * size[1]
            out += bytes(palette[3 * p] for p in pixels)
            continue
        while data[at]:
            at += 1 + data[at]
        at += 1
    return bytes(out), delays


def test_stored_bytes_by_another_decoder(spark):
    given = dict(list(texts(spark).items())[:40])
    given |= {-1: None, -2: "", -3: "x" * (64 * gif.ROWS + 5), -4: "é字🙂" * 100}
    docs = frame(spark, given.items())
    media = {r.doc_id: r.media for r in gif.store(docs).collect()}
    for r in gif.round_trip(docs).collect():
        raw = gif.payload((given[r.doc_id] or "").encode())
        stored = bytes(media[r.doc_id])
        back, delays = textbook_gif(stored)
        assert back == raw and r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        quarter = collections.Counter(b >> 6 for b in raw)
        assert r.feature == f"frames={len(delays)};ms={sum(delays)};hist=" + "/".join(str(quarter[i]) for i in range(4))


def test_broken_streams_have_a_row_each(spark):
    whole = gif.encode(bytes(range(64)) * 4)
    two = gif.encode(b"a" * 64 * 6, rows=3)
    bad = {
        1: b"GIF89a", 2: b"", 3: b"PNG", 4: whole[:20], 5: whole[:-30], 6: whole[: 13 + 768] + b"\x99" + whole[13 + 768 :], 7: b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b",
        8: two[:-20], 9: whole[:-1], 10: two,
    }
    r = random.Random(5)
    for i in range(100, 160):
        noise = bytearray(two)
        for _ in range(r.randrange(1, 6)):
            noise[r.randrange(6, len(noise))] = r.randrange(256)
        bad[i] = bytes(noise)
    rows = gif.frames(spark.createDataFrame([(k, v) for k, v in bad.items()] + [(99, None)], "doc_id long, media binary")).collect()
    good, errors = collections.Counter(x.doc_id for x in rows if x.error is None), {x.doc_id: x for x in rows if x.error is not None}
    assert set(errors) >= {1, 2, 3, 4, 5, 6, 7, 8} and good[10] == 2 and good[9] == 1 and good[8] == 1 and 99 not in good
    assert errors[1].frame is None and "large" in errors[7].error and {x.doc_id for x in rows} == set(bad)


# ---- op6


def test_offsets_lead_back_to_any_range(spark):
    given = {**dict(list(texts(spark).items())[:30]), -1: None, -2: "", -3: "a é字🙂\n\n  don't 123 " * 40}
    coded = bpe.encode(frame(spark, given.items()), PATH)
    for r in coded.collect():
        raw = (given[r.doc_id] or "").encode()
        ids = LIBRARY.encode_ordinary(given[r.doc_id] or "")
        ends = np.cumsum([len(LIBRARY.decode_single_token_bytes(i)) for i in ids]).tolist() if ids else []
        assert (list(r.ids), list(r.ends)) == (ids, ends) and (not ends or ends[-1] == len(raw))
    for first, last in ((0, None), (0, 10), (7, 8), (13, 60), (5, 5), (10**6, None)):
        for r in bpe.decode(coded, PATH, first, last).collect():
            assert r.text == (given[r.doc_id] or "").encode()[first:last].decode("utf-8", "replace")
    with pytest.raises(Exception, match="offsets of other tokens"):
        bpe.decode(coded.withColumn("ends", F.transform("ends", lambda e: e * 2)), PATH).collect()
    assert public_tokenizers.PATTERN


# ---- op2

LETTER_RUN = re.compile(rb"[A-Za-z\x80-\xff]+")


def key_of(raw):
    return int(textarrays.hash_runs(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0] & ~np.uint64(1))


def plain_severity(text, model):
    words = LETTER_RUN.findall((text or "").encode().translate(bytes(textarrays.LOWER)))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    eta = sum(weights.get(signed(key_of(w)), 0.0) for w in set(words))
    begins = collections.Counter(w[:n] for w in words for n in toxicity.BEGINNINGS if len(w) > n)
    for b, times in begins.items():
        total = sum(int(textarrays.BYTE_CODE[c]) * int(textarrays.POSITION_CODE[j]) for j, c in enumerate(b)) % (1 << 64)
        k = int(textarrays.mix(np.array([(total + len(b) - 1) % (1 << 64)], np.uint64))[0] | np.uint64(1))
        eta += weights.get(signed(k), 0.0) * min(1.0, toxicity.DENSE * times / len(words))
    above = [1 / (1 + math.exp(t - eta)) if t < 700 else 0.0 for t in model.thetas]
    levels = model.levels.tolist()
    return sum((levels[i + 1] - levels[i]) * p for i, p in enumerate(above)), above[0], levels[sum(p >= 0.5 for p in above)]


def test_severity_equals_a_plain_version(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert len(model.keys)
    given = {**dict(list(texts(spark).items())[:80]), -1: None, -2: ""}
    for r in toxicity.score(frame(spark, given.items()), model).collect():
        severity, p, grade = plain_severity(given[r.doc_id], model)
        assert r.expected_severity == pytest.approx(severity, abs=1e-9) and r.p_toxic == pytest.approx(p, abs=1e-9) and r.grade == grade and r.toxic == (p >= 0.5)


def test_grades_keep_their_numbers_and_the_sample_its_bound(spark):
    rows = [(i, ("nasty brute " if i % 2 else "kind soul ") * 6 + f"word{i}x") for i in range(60)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    out = toxicity.toxicity(docs, labels).collect()
    assert {r.grade for r in out if r.doc_id % 2} == {2} and {r.grade for r in out if not r.doc_id % 2} == {0}
    assert all(r.expected_severity == pytest.approx(2 * r.p_toxic) for r in out)
    huge = docs.unionByName(frame(spark, [(1, " ".join(f"w{i}q" for i in range(5000)))]))
    model = toxicity.fit(huge, labels, sample_features=1500)
    assert {r.doc_id % 2 for r in toxicity.score(docs, model).where("toxic").collect()} == {1}


def test_thresholds_and_weights_are_where_the_likelihood_is_greatest():
    r = np.random.default_rng(3)
    n, d = 400, 5
    x = (r.random((n, d)) < 0.4).astype(float)
    eta = x @ np.array([2.0, -1.5, 0.0, 1.0, 0.0])
    noise = np.log(1 / r.random(n) - 1)
    grades = (eta + noise > 0.5).astype(int) + (eta + noise > 2.0).astype(int)
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit_arrays(rows, columns, np.ones(len(rows)), d, grades, 0.0, 1500)

    def loss(w, theta):
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        p = 1 / (1 + np.exp(-(cut[grades + 1] - x @ w))) - 1 / (1 + np.exp(-(cut[grades] - x @ w)))
        return -np.log(p).mean()

    best = loss(w, theta)
    for i in range(d + 2):
        for step in (-0.05, 0.05):
            move = np.eye(d + 2)[i] * step
            assert loss(w + move[:d], theta + move[d:]) > best - 1e-5
    assert theta[0] < theta[1]


# ---- op10


def test_ratio_and_verdict_equal_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    given = texts(spark)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    word_hash = lambda w: int(textarrays.hash_runs(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])

    def buckets(text):
        h = [word_hash(w) for w in WORD.findall(text or "")]
        pairs = [int(textarrays.window_hashes(np.array(p, np.uint64), 2)[0]) for p in zip(h[:-1], h[1:], strict=True)]
        return [x >> 48 for x in h + pairs]

    raw, target = collections.Counter(), collections.Counter()
    own = {i: buckets(t) for i, t in given.items()}
    for i, b in own.items():
        raw.update(b)
        if i in good:
            target.update(b)
    size = 1 << 16
    n_raw, n_target = size + sum(raw.values()), size + sum(target.values())
    for r in quality.quality_rules(docs, labels).collect():
        b = own[r.doc_id]
        llr = sum(math.log((target[x] + 1) / n_target) - math.log((raw[x] + 1) / n_raw) for x in b) / len(b) if b else 0.0
        assert r.llr == pytest.approx(llr, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= -0.1)
    assert queries.QUERIES["op10_quality_rules"](spark, SF).count() == docs.count()


# ---- op3


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_both_forms_of_backoff_equal_a_plain_version(spark, order):
    r = random.Random(order)
    rows = [(i, " ".join(r.choice("abcdeFGH") for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(99, None), (98, " "), (97, "a"), (96, "zz zz zz")]
    docs = frame(spark, rows)
    packed = {x.doc_id: x for x in ngram_lm.backoff_scores(docs, order, chunk_bytes=300, part_grams=50).collect()}
    plain = {x.doc_id: x for x in ngram_lm.scores_by_rows(docs, order).collect()}
    for i, (n, s) in brute_lm(rows, order).items():
        for got in (packed[i], plain[i]):
            assert got.n_tokens == n and (got.log_score is None if n == 0 else got.log_score == pytest.approx(s, abs=1e-6))
        assert packed[i].n_backed_off == plain[i].n_backed_off


def test_backoff_of_rows_without_ids_and_of_equal_rows(spark):
    rows = [(None, f"w{i} common words here") for i in range(30)] + [(5, "same id other text"), (5, "common words here"), (5, "common words here"), (None, None)]
    docs = frame(spark, rows)
    packed = ngram_lm.backoff_scores(docs, 3, chunk_bytes=100, part_grams=20).collect()
    plain = ngram_lm.scores_by_rows(docs, 3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_backed_off, round(r.log_score or 0, 6))
    assert len(packed) == len(rows) and sorted(map(key, packed)) == sorted(map(key, plain))
