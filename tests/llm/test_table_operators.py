"""Sharding, mixing, exact search, secrets, surrogates and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from shelfline.llm.mixing import mixed_documents, permuted, taken_words
from shelfline.llm.pii import pseudonymise
from shelfline.llm.secrets import MASK, findings, redact
from shelfline.llm.sharding import shard_by_sampled_splitters
from shelfline.llm.topk import quantised, top_k, top_k_of_every_hundredth
from tests.llm.helpers import PROSE, no_documents, odd_documents, sample
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_shards(spark):
    for docs in (odd_documents(spark), sample(spark)):
        rows, got = docs.collect(), shard_by_sampled_splitters(docs, 8).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert shard_by_sampled_splitters(no_documents(spark), 8).count() == 0


def test_shards_are_near_equal_with_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")))).alias("text"))
    got = shard_by_sampled_splitters(docs, 8).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    sizes = [r.bytes for r in got]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.06
    again = shard_by_sampled_splitters(docs.repartition(7), 8)
    first = shard_by_sampled_splitters(docs, 8)
    assert first.exceptAll(again).count() == 0


def targets(sizes):
    """sizes by source, in order: shares of 5, 2, 1 with limits at three times the size."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(free.values())
        over = {s: 3 * sizes[s] for s, w in free.items() if level * w > 3 * sizes[s]}
        if not over:
            return capped | {s: level * w for s, w in free.items()}
        capped |= over


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(spark):
    uneven = spark.createDataFrame([(i, "w " * (1 + i % 50), None, s, None, 0, "", 0, "") for i, s in enumerate(["a"] * 300 + ["b"] * 2 + ["c"] * 40 + [None] * 9)],
                                   odd_documents(spark).schema)
    for docs in (odd_documents(spark), sample(spark), uneven):
        rows, got = docs.collect(), taken_words(docs).collect()
        sizes = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r.source is None, r.source or "")):
            sizes[r.source] += len(words(r.text))
        want = targets(dict(sizes))
        assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len(words(r.text))) for r in rows)
        taken = defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        assert taken_words(docs.repartition(5)).exceptAll(taken_words(docs)).count() == 0
    assert taken_words(no_documents(spark)).count() == 0


def test_mix_as_documents(spark):
    docs = sample(spark)
    by_id = {r.doc_id: r for r in taken_words(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    counted = defaultdict(int)
    for r in mixed.collect():
        counted[r.doc_id] += len(words(r.text))
        assert not Counter(words(r.text)) - Counter(words(texts[r.doc_id]))
    assert {i: n for i, n in counted.items() if n} == {i: r.taken for i, r in by_id.items() if r.taken}
    assert mixed_documents(odd_documents(spark)).columns == odd_documents(spark).columns
    assert mixed_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation(size):
    index, sizes, key = np.arange(size), np.full(size, size), np.full(size, 99)
    there = permuted(index, sizes, key)
    assert sorted(there.tolist()) == list(range(size))
    assert permuted(there, sizes, key, inverse=True).tolist() == index.tolist()


def test_top_k_matches_sql(spark):
    con = connect(SF)
    assert compare(spark, con, "op5_segment_topk", entry.queries()["op5_segment_topk"], entry.oracle_sql()["op5_segment_topk"], SF) == []


def test_top_k_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=20)], 0) for i in range(60)]
    rows += [(100, rows[3][1], 1), (101, rows[3][1], 1), (102, None, 1), (103, [], 1), (104, [None] * 20, 1), (105, [float("nan")] * 20, 1), (106, [float("inf")] * 20, 1),
             (107, [0.5] * 7, 1), (None, rows[4][1], 1), (200, [0.0] * 20, 1), rows[5], rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k_of_every_hundredth(table).collect()}
    kept = {r.vec_id: list(r.vec) for r in quantised(table).collect()}
    assert set(kept) == {*range(60), 100, 101, 107, 200}
    for q in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q and len(v) == 20)
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in scores[:10]]
    assert top_k_of_every_hundredth(table.limit(0)).count() == 0
    few = quantised(table.filter("vec_id < 4"))
    assert top_k(few, few.filter("vec_id = 0"), 10).count() == 3


def test_top_k_with_large_components(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 10.0 ** int(rng.integers(0, 9))]) for i in range(40)]
    rows += [(100, [40000.0] + [1.0] * 7), (200, [1.0, 2.0] + [0.0] * 6), (300, [1e300, -1e300] + [0.0] * 6), (400, [float(2 ** 31)] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    cut = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k_of_every_hundredth(table).collect()}
    for q in (0, 100, 200, 300, 400):
        want = sorted((-cut(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in want], q


SECRET = "AKIA" + "Q7ZK2M4N8P1R5T3V"


def secret_documents(spark):
    rows = [(i, f"{PROSE} password=a{i}f{i * 7919 % 99991}e83c78305 {PROSE}", "en", "s", 1) for i in range(40)]
    rows += [(100 + i, f"{PROSE} number {4000000000000000 + i * 7654321} at path/to/file{i}0/img{i}00a {PROSE}", "en", "s", 1) for i in range(40)]
    rows += [(200, f"key {SECRET}, again {SECRET}", "en", "s", 1), (201, PROSE, "en", "s", 1), (202, None, None, None, None), (203, "", "en", "s", 0)]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, probability string, start long")


def test_secrets(spark):
    docs = secret_documents(spark)
    found = findings(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        assert hashlib.sha256(texts[r.doc_id][r.start - 1:r.start - 1 + r.length].encode()).hexdigest() == r.value_sha256
    secret = Counter(r.doc_id for r in found if r.is_secret)
    assert secret == Counter({**dict.fromkeys(range(40), 1), 0: 2, 200: 2})
    cleaned = {r.doc_id: r.text for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns and redact(docs).count() == docs.count()
    assert cleaned[200] == f"key {MASK}, again {MASK}" and all(MASK in cleaned[i] for i in range(40))
    assert all(cleaned[i] == texts[i] for i in texts if i not in secret)
    for odd in (odd_documents(spark), no_documents(spark)):
        assert redact(odd).exceptAll(odd).count() == 0 and redact(odd).count() == odd.count()
        assert findings(odd).filter("is_secret").count() == 0


def test_dictionary_holds_the_words_of_all_documents(spark):
    from shelfline.llm.secrets import dictionary

    spell = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(5))
    docs = spark.createDataFrame([(i, f"{spell(i // 2)} password = '{'z' * 5} {i}'") for i in range(10_000)], "doc_id long, text string")
    words = {r.word for r in dictionary(docs).collect()}
    assert words == {spell(i) for i in range(5_000)} | {"password"}


def test_values_of_credentials_are_candidates_whatever_they_hold(spark):
    values = ['password = "correct-horse-battery"', "token: qwertyuiopasdf", "passwd='p@$$ w.rd!'", "secret=x;y!", "api_key: short,"]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = {r.doc_id: r.value_sha256 for r in findings(docs).collect()}
    want = ["correct-horse-battery", "qwertyuiopasdf", "p@$$ w.rd!", "x;y!", "short"]
    assert found == {i: hashlib.sha256(v.encode()).hexdigest() for i, v in enumerate(want)}
    assert redact(docs).count() == len(values)


def luhn(number):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def test_surrogates(spark):
    rows = [(1, "Dear Mr. John Smith, write to Bob.Roe@Example.com or bob.roe@example.com."), (2, "Mrs Anna Smith and Herr Smith, card 4111-1111-1111-1111 or 4111 1111 1111 1111"),
            (3, None), (4, ""), (5, "at 10.20.30.40 and v1.2.3.4.5, 1234567890123456"), (6, "Mr Иван Петров, +1 (988) 555-2485"), (7, PROSE)]
    rows += [(100 + i, f"mail a{i}@b.org and {i % 9 + 1}.{i // 9 % 9 + 1}.1.1") for i in range(81)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("surrogate", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r.doc_id: r.text for r in pseudonymise(docs, "k").collect()}
    assert pseudonymise(docs, "k").count() == docs.count()
    for private in ("John", "Smith", "Anna", "Bob", "bob", "4111", "10.20.30.40", "Иван", "Петров", "988"):
        assert not any(private in (t or "") for i, t in got.items() if i < 100), private
    assert got[3] is None and got[4] == "" and got[7] == PROSE and "v1.2.3.4.5, 1234567890123456" in got[5]
    first = re.match(r"Dear Mr. (\w+) (\w+), write to (\S+) or (\S+)\.$", got[1])
    assert first[3].lower() == first[4] and first[3] != first[4] and re.fullmatch(r"[A-Z]\w\w\.[A-Z]\w\w@[A-Z]\w{6}\.com", first[3])
    second = re.match(r"Mrs (\w+) (\w+) and Herr (\w+), card ([\d-]+) or ([\d ]+)$", got[2])
    assert second[2] == second[3] == first[2] and second[1].endswith("a") and not first[1].endswith("a")
    assert second[4].replace("-", "") == second[5].replace(" ", "") and luhn(second[5].replace(" ", ""))
    assert re.fullmatch(r"Mr [Ѐ-ӿ]+ [Ѐ-ӿ]+, \+\d \(\d{3}\) \d{3}-\d{4}", got[6])
    mails, addresses = zip(*(re.match(r"mail (\S+) and (\S+)$", got[100 + i]).groups() for i in range(81)), strict=True)
    assert len(set(mails)) == 81 and len(set(addresses)) == 81
    assert not set(addresses) & {f"{i % 9 + 1}.{i // 9 % 9 + 1}.1.1" for i in range(81)}
    assert got == {r.doc_id: r.text for r in pseudonymise(docs.repartition(3), "k").collect()}
    assert got[1] != {r.doc_id: r.text for r in pseudonymise(docs, "other").collect()}[1]
    for odd in (odd_documents(spark), no_documents(spark)):
        assert pseudonymise(odd).drop("n_surrogates").exceptAll(odd).count() == 0


PRIVATE = [
    ("Mr John Smith spoke. Smith said yes, and John left; SMITH too, but not Smithson.", ["John", "Smith ", "SMITH"], 4),
    ("MR BROWN, Dr Jones and Prof. Adams met Mr J. Doe.", ["BROWN", "Jones", "Adams", "Doe"], 4),
    ("Call 555-123-4567, 020 7946 0958 or +33 1 23 45 67 89.", ["555-123", "7946", "23 45"], 3),
    ("Г-н Иванов и Госпожа Анна Петрова; Иванов ушёл.", ["Иванов", "Анна", "Петрова"], 3),
    ("Mrs Mary-Jane O'Brien and Herr Ludwig van der Berg, then Berg again.", ["Mary", "Jane", "Brien", "Ludwig", "Berg"], 3)]
PUBLIC = ["On 2024-01-15 10:30 we had 1 200 300 visits, version 1.2.3, room 12-34, 50 60 70 80 90.", "The doctor saw Profit and Misses; mr smith wrote in lower case.",
          "ISBN 978-3-16-148410-0 costs 0.50 or 0,75, ratio 1234567890123456, part 000-111"]


def test_every_mention_and_shape_of_personal_data(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(PRIVATE)] + [(100 + i, t) for i, t in enumerate(PUBLIC)]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (text, private, n) in enumerate(PRIVATE):
        assert not any(p in got[i].text for p in private) and got[i].n_surrogates == n, got[i]
    assert [got[100 + i].text for i in range(len(PUBLIC))] == PUBLIC and all(got[100 + i].n_surrogates == 0 for i in range(len(PUBLIC)))
    first = re.match(r"Mr (\w+) (\w+) spoke. (\w+) said yes, and (\w+) left; (\w+) too, but not Smithson\.$", got[0].text)
    assert first[2] == first[3] == first[5].capitalize() and first[5].isupper() and first[1] == first[4]
    assert re.fullmatch(r"MR [A-Z]+, Dr [A-Z][a-z]+ and Prof\. [A-Z][a-z]+ met Mr [A-Z]\. [A-Z][a-z]+\.", got[1].text)
    assert re.fullmatch(r"Call 5\d\d-\d{3}-\d{4}, 0\d\d \d{4} \d{4} or \+3\d \d \d\d \d\d \d\d \d\d\.", got[2].text)
    assert re.fullmatch(r"Mrs [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+'[A-Z][a-z]+ and Herr [A-Z][a-z]+ van der ([A-Z][a-z]+), then \1 again\.", got[4].text)


def test_surrogates_where_all_forms_are_real(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = spark.createDataFrame([(i, f"{a}@{b}.org") for i, (a, b) in enumerate((a, b) for a in letters for b in letters)], "doc_id long, text string")
    got = [r.text for r in pseudonymise(docs.withColumn("n_surrogates", F.lit("old")), "k").collect()]
    assert len(set(got)) == 676 and not set(got) & {r.text for r in docs.collect()} and all(re.fullmatch(r"[a-z]+@[a-z]\.org", t) for t in got)


def test_nothing_private_is_left_in_the_shared_folder(spark, tmp_path, monkeypatch):
    written_tables = []
    from shelfline.llm import pii

    monkeypatch.setattr(pii, "stored", lambda df, name: written_tables.append(df.cache()) or df)
    rows = [(1, "Mr John Smithers, john.smithers@example.com, 10.20.30.40, +1 (988) 555-2485, 4111 1111 1111 1111")]
    pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    kept = " ".join(str(r) for df in written_tables for r in df.collect()).lower()
    assert written_tables and not any(p in kept for p in ("john", "smithers", "example", "10.20.30", "9885552485", "41111111"))


def test_pipeline(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "secrets", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for odd in (odd_documents(spark), no_documents(spark)):
            assert stage(spark, odd, SF).columns == odd.columns
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert 0 < kept.count() < docs.count() and kept.exceptAll(docs).count() == 0


def test_every_operator_is_registered():
    queries = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in queries) for n in range(1, 14))
