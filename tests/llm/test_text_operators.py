"""Byte-level BPE, token counts, quality statistics, fingerprints: against libraries and brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash

from shelfline.llm.bpe import encode_documents, encoder_for
from shelfline.llm.lm_scoring import score_documents, words_of_text
from shelfline.llm.quality import judge_quality
from shelfline.llm.simhash import covering_masks, forest, near_duplicates, without_near_duplicates
from shelfline.llm.token_counts import count_pieces, pre_tokens, processor_for, token_counts
from tests.llm.helpers import PROSE, no_documents, odd_documents, sample

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "a", "aaaaaaaaaaaaaaaaaaaa" * 40, "I'm  it's\n\n x ", "<|endoftext|>", "日本語テキスト" * 60, "=" * 333, " \x85a b",
                                  "ab" * 700, "\t tab  \n"])
def test_bpe_matches_library(tik, text):
    encoder = encoder_for(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    ids = encoder.encode(pa.array([text, None, text + " end"]))
    assert ids.flat[:ids.lengths[0]].tolist() == tik.encode_ordinary(text)
    assert ids.lengths[1] == 0
    assert encoder.decode(ids).flat.tobytes().decode() == text + text + " end"


def test_bpe_random(tik):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeb n\n.,'12éß") for _ in range(rng.randrange(400))) for _ in range(200)]
    ids = encoder_for(open(RANKS, "rb").read(), public_tokenizers.PATTERN).encode(pa.array(texts))
    for text, start, n in zip(texts, ids.starts, ids.lengths, strict=True):
        assert ids.flat[start:start + n].tolist() == tik.encode_ordinary(text)


def test_bpe_documents(spark, tik):
    for docs in (odd_documents(spark), sample(spark)):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect())
        want = Counter()
        for r in docs.collect():
            ids = tik.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert got == want
    assert encode_documents(no_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark):
    processor = processor_for(open(PIECES, "rb").read())
    for text in ["", " ", "  a", "a\nb", "\n", "<s>a</s>", "▁a", "a▁ ▁b", "e" * 900, "\0a\r\n", "日本 語"]:
        assert count_pieces(processor, pre_tokens(text)).sum() == len(processor.encode(text)), text
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd_documents(spark), sample(spark)):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PIECES, 100).collect())
        want = Counter()
        for r in docs.collect():
            n = len(library.encode(r.text or ""))
            want[r.doc_id, len((r.text or "").encode()), n, n > 100] += 1
        assert got == want
    assert token_counts(no_documents(spark), PIECES).count() == 0


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    for docs in (odd_documents(spark), sample(spark)):
        judged = judge_quality(docs, ["doc_id"])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        got = Counter((r.doc_id, *(r[n] for n in names)) for r in judged.select("row.doc_id", *names).collect())
        assert got == Counter((r.doc_id, *statistics(r.text)) for r in docs.collect())
        for r in judged.collect():
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert judge_quality(no_documents(spark), ["doc_id"]).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in ("re", "the", "con") for b in ("la", "mi", "to", "ne") for c in ("n", "st", "r", "")]
    plain = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) + str(rng.randrange(9)) for _ in range(rng.randrange(60, 400))), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(vocabulary) + "###" + str(j) for j in range(120)), "en", "a") for i in range(60)]
    judged = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string"), ["doc_id"])
              .select("row.doc_id", "kept").collect()}
    assert all(judged[i] for i, *_ in plain)
    assert not any(judged[i] for i, *_ in junk)


def test_quality_concentrates_until_every_stratum_settles(spark):
    """Two strata that need many steps: the estimates are fixed points, the same as those of plain steps one stratum at a time."""
    from shelfline.llm import quality

    rng = np.random.default_rng(17)
    parts = {name: np.vstack((rng.standard_t(1.2, (700, 4)), rng.normal(3, 2, (500, 4)))) for name in "ab"}
    rows = [(name, *map(float, x)) for name, values in parts.items() for x in values]
    found = quality.minimum_covariance(spark.createDataFrame(rows, "stratum string, x1 double, x2 double, x3 double, x4 double"), True)
    got = {r.e_stratum: [r[f"m{i}"] for i in range(4)] for r in found.collect()}
    floor = np.diag(np.square(quality.FLOOR))

    def nearest(values, distance):
        grade = np.floor(np.log1p(distance) * 1000)
        return values[grade <= np.quantile(grade, quality.SHARE)]

    for name, values in parts.items():
        centre = np.median(values.round(3), axis=0)
        spread = np.median(np.abs(values - centre).round(3), axis=0) * 1.4826 + quality.FLOOR
        settled, most = [], 0
        for subset in (nearest(values, (((values - centre) / spread) ** 2).sum(axis=1)), values):
            last, steps = (np.inf, None), 0
            while True:
                off = values - subset.mean(axis=0)
                scatter = np.cov(subset.T, bias=True) + floor
                subset = nearest(values, (off @ np.linalg.inv(scatter) * off).sum(axis=1))
                now = round(float(np.linalg.slogdet(np.cov(subset.T, bias=True) + floor)[1]), 9)
                if now >= last[0]:
                    break
                last, steps = (now, subset.mean(axis=0)), steps + 1
            settled.append(last)
            most = max(most, steps)
        assert most > 5
        assert np.allclose(got[name], min(settled, key=lambda s: s[0])[1], atol=1e-6)


def test_quality_rejects_repeated_windows_alone(spark):
    """Nearly half of the words in repeated windows passes the base rules; among texts without any it is an outlier by that alone."""
    rng = random.Random(6)
    words = lambda n: [f"{rng.randrange(10 ** 5):05d}" for _ in range(n)]
    rows = [(i, " ".join(words(100)), "en", "a") for i in range(200)]
    rows += [(1000 + i, " ".join(w[:24] + w[:24] + w[24:]), "en", "a") for i in range(5) for w in [words(76)]]
    judged = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
              .select("row.doc_id", "base_failed", "kept").collect()}
    assert not any(r.base_failed for r in judged.values())
    assert all(r.kept == (i < 1000) for i, r in judged.items())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_covering_masks():
    rng = random.Random(1)
    masks = covering_masks(list(range(64)))
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(not difference & m for m in masks)


def test_near_duplicates(spark):
    for docs in (odd_documents(spark), sample(spark)):
        rows = docs.collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        component = brute_components(prints)
        ids = {c: min((r.doc_id for r, k in zip(rows, component, strict=True) if k == c and r.doc_id is not None), default=None) for c in component}
        want = Counter((r.doc_id, f"{p:016x}", ids[c]) for r, p, c in zip(rows, prints, component, strict=True))
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()) == want
        assert without_near_duplicates(docs).count() == len(set(component))
    assert near_duplicates(no_documents(spark)).count() == 0


def test_every_component_keeps_a_row_whatever_its_ids(spark):
    rng = random.Random(4)
    text = lambda: " ".join(str(rng.randrange(10 ** 6)) for _ in range(60))
    alone = [(None, text()) for _ in range(6)] + [(1, text()), (1, text()), (2, text())]
    shared = text()
    kept = without_near_duplicates(spark.createDataFrame([*alone, (None, shared), (9, shared), (7, shared)], "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([*alone, (7, shared)])


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    from shelfline.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 10)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(24)})
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long"))
    parent = {p: p for (p,) in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links.distinct().collect():
        parent[find(r.u)] = find(r.v)
    want = brute_components(prints)
    same = lambda labels: [[a == b for a in labels] for b in labels]
    assert same([find(p) for (p,) in rows]) == same(want)


def test_forest_is_linear_in_a_dense_group():
    values = np.arange(256, dtype=np.uint64)
    u, v = forest(values, 4)
    assert len(u) == 255 and set(v.tolist()) == {0}


def test_scores(spark):
    docs = odd_documents(spark)
    scored = score_documents(docs, spark.createDataFrame([(0,), (None,)], "doc_id long")).collect()
    assert len(scored) == docs.count()
    by_id = {r.doc_id: r for r in scored}
    assert by_id[2].n_tokens == 0 and by_id[2].score is None and by_id[3].score is None
    assert by_id[0].score < by_id[12].score
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-9 for r in scored if r.score is not None)
    empty = spark.createDataFrame([], "doc_id long")
    assert score_documents(no_documents(spark), empty).count() == 0
    assert len(score_documents(docs, empty).collect()) == len(scored)


@pytest.mark.parametrize("known", [0, 3, 2_100, 1 << 20])
def test_losses_are_those_of_models_of_every_word(spark, known):
    """More words than any dense table holds; each must keep counts of its own, whichever way it takes."""
    rng = random.Random(4)
    lines = [" ".join(f"w{int(rng.paretovariate(0.45)) % 6_000}" for _ in range(rng.randrange(1, 240))) for _ in range(600)] + ["W1 w1, lone", "w1 w1 lone", "", ". w2"]
    rows = [(i, t) for i, t in enumerate(lines)] + [(7, lines[7]), (7, "another text"), (None, lines[8]), (None, None), (900, None)]
    targets = set(range(0, 604, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [words_of_text(t or "") for _, t in rows]
    assert len({w for found in words for w in found}) > 2_500

    def model(texts):
        pairs = Counter(p for found in texts for p in zip([None, *found], found, strict=False))
        totals, kinds, own = Counter(), Counter(v for v, _ in pairs), Counter()
        for (v, w), n in pairs.items():
            totals[v] += n
            own[w] += n
        whole = sum(own.values()) + 0.5 * len({w for found in words for w in found})

        def loss(found):
            shares = [(own[w] + 0.5) / whole for w in found]
            terms = [(max(pairs[v, w] - 0.75, 0) + (0.75 * kinds[v] + 20) * share) / (totals[v] + 20)
                     for v, w, share in zip([None, *found], found, shares, strict=False)]
            return -sum(map(math.log, terms)) / len(terms) if terms else None

        return loss

    target, background = model([found for (i, _), found in zip(rows, words, strict=True) if i in targets]), model(words)
    order = lambda row: tuple((v is not None, v) for v in row)
    want = sorted([(i, len(found), target(found), background(found)) for (i, _), found in zip(rows, words, strict=True)], key=order)
    got = sorted([(r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in score_documents(
        docs, spark.createDataFrame([(i,) for i in targets], "doc_id long"), known).collect()], key=order)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == (pytest.approx(b[2:], abs=1e-5) if b[1] else (None, None))


def test_scores_tell_held_out_documents_apart(spark):
    """Half of the good documents train the target model; the other half must score below the bad ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.filter("quality = 1 AND pmod(xxhash64(doc_id), 2) = 0").select("doc_id")
    held = labels.join(train, "doc_id", "left_anti")
    scored = score_documents(docs, train).join(held, "doc_id").filter("score IS NOT NULL").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    wins = sum(g < b for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9
    assert PROSE
