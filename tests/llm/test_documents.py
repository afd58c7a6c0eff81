"""Document operators against brute force, on odd rows and on the driver's small table."""

import collections
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, mixing, packing, quality_classifier, quality_rules, simhash, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- token counts -------------------------------------------------------------------


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, odd, empty, tmp_path):
    cache = str(tmp_path / "cache")
    t = encoder()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.token_counts(odd, cache).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    before = stored.count()
    again = token_counts.token_counts(odd, cache).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in again) == want
    assert spark.read.parquet(cache).count() == before  # nothing was encoded again
    assert token_counts.token_counts(empty, cache).count() == 0


def test_token_cache_by_version(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    a = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd.where("doc_id = 1"), cache).collect()}
    b = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd.where("doc_id = 1"), cache, "piece_bpe_32k.model").collect()}
    assert a != b and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


# --- quality rules ------------------------------------------------------------------


def measures(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for ps in at.values() if len(ps) > 1 for p in ps for j in range(p, p + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, empty, small):
    for df in (odd, small):
        want = collections.Counter((r.doc_id, *measures(r.text)) for r in df.collect())
        led = quality_rules.ledger(df)
        got = led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert collections.Counter(map(tuple, got)) == want
    assert quality_rules.ledger(empty).count() == 0
    kept = quality_rules.keep(odd, "base")
    assert kept.columns == odd.columns
    good = [r.doc_id for r in odd.collect() if (m := measures(r.text))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, good))


def test_quality_policies_and_ablation(spark, small):
    led = quality_rules.ledger(small)
    rows = led.select("fail_bits").collect()
    for r in quality_rules.ablation(led).collect():
        mask = quality_rules.POLICIES[r.policy]
        assert r.n_fail == sum(bool(x.fail_bits & r.bit) for x in rows)
        assert r.n_only == sum((x.fail_bits & mask) == r.bit for x in rows)
    assert {r.policy for r in quality_rules.policy_table(spark).collect()} == set(quality_rules.POLICIES)
    # a filter above the ledger must not copy its nested expressions
    assert led.where("fail_bits = 0").count() == sum(x.fail_bits == 0 for x in rows)


# --- SimHash ------------------------------------------------------------------------


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x.encode() for x in words(w)]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(keys, near):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def test_simhash(odd, empty, small):
    for df in (odd, small):
        rows = df.select("doc_id", "text").collect()
        fps = [fingerprint(r.text) for r in rows]
        root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for r, g in zip(rows, root):
            if r.doc_id is not None:
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
        want = collections.Counter((r.doc_id, f - (1 << 64) if f >> 63 else f, least.get(g)) for r, f, g in zip(rows, fps, root))
        assert collections.Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(r.doc_id for r in odd.collect() if r.doc_id and least_of(odd, r.doc_id) == r.doc_id)


def least_of(df, doc_id):
    return next(r.component_id for r in simhash.near_duplicates(df).where(F.col("doc_id") == doc_id).collect())


def test_simhash_links_in_dense_groups(spark):
    """Lists long enough for the look-up path, chains, and unlinked fingerprints."""
    import random

    rng = random.Random(7)
    base, fps = rng.getrandbits(64), set()
    for _ in range(900):
        x = base
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 40, 63])
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    found = {r.node: r.component for r in simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    groups = collections.defaultdict(list)
    for s, g in zip(signed, root):
        groups[g].append(s)
    for g in groups.values():
        assert [found.get(s) for s in g] == ([min(g)] * len(g) if len(g) > 1 else [None])


def test_simhash_count_filter(spark):
    """Pairs that meet in a list with four or five shared bytes are dropped by their tally, not by their bits."""
    import random

    import numpy as np

    rng = random.Random(11)
    base = rng.getrandbits(64)
    four = base ^ 0x01_01_01_01_00_00_00_00  # shares four bytes, differs in four bits
    five = base ^ 0x01_00_00_01_00_00_01_00
    near, wide = base ^ 0x10_00_00_00_00_00_00_01, base ^ 0x07_00_00_00_00_00_00_00
    fps = np.array([base, four, five, near, wide], np.uint64)
    assert simhash.tallied(fps)[0].tolist() == [8, 4, 5, 6, 7]
    assert any(all(not (base ^ x) >> 8 * p & 255 for p in s) for s in simhash.SETS for x in (four,))  # they do meet
    assert simhash._by_tally(fps) == [(3, 0)]  # 7 shared bytes and 3 bits: verification rejects
    signed = [f - (1 << 64) if f >> 63 else f for f in fps.tolist()]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {frozenset((signed[0], signed[3]))}


@pytest.mark.parametrize("pairwise", [0, 3, 10_000])
def test_simhash_lists_of_any_length(spark, monkeypatch, pairwise):
    """The refined path and the pairwise path give the same groups as brute force."""
    import random

    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 2 if (a < 0) == (b < 0) else ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    want = collections.Counter(root)
    found = {r.node: r.component for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    assert {x: found[x] for x in found} == {x: fps[g] for x, g in zip(fps, root) if want[g] > 1}


def test_keep_one_judges_rows(spark):
    a = "The quick brown fox jumps over the lazy dog while seven wizards brew strong potions in a quiet valley tonight."
    b = "Nothing of this second text has been said before, neither by the fox nor by any of the wizards it met."
    c = "A third text that only rows without an id hold, and that is written twice in this small table of ours."
    docs = spark.createDataFrame([(1, a, 7), (5, a, 8), (5, b, 9), (None, a, 1), (None, c, 2), (None, c, 3), (6, None, 4), (7, "", 5)], "doc_id long, text string, fp long")
    assert sorted(map(str, (tuple(r) for r in simhash.keep_one(docs).collect()))) == sorted(map(str, [(1, a, 7), (5, b, 9), (None, c, 2), (None, c, 3), (6, None, 4)]))


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(900, i) for i in range(300)] + [(i + 1000, 900) for i in range(300)], "a long, b long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert set(found.values()) == {0} and len(found) == 601


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert simhash.components(edges.limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------


def water_fill(sizes):
    """Targets by resharing the excess until no source is over its double."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(odd, empty, small):
    for df in (odd, small):
        rows = df.select("doc_id", "text", "source").collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += len(words(r.text))
        want = water_fill(sizes)
        got = mixing.decide(mixing.sized(df)).collect()
        assert sorted(str((r.doc_id, r["size"])) for r in got) == sorted(str((r.doc_id, len(words(r.text)))) for r in rows)
        near = sorted(round(t, 6) for t in want.values())
        assert sorted({round(r.target, 6) for r in got}) == sorted(set(near))
        assert all(0 <= r.taken <= 2 * r["size"] for r in got)
        assert abs(sum(r.taken for r in got) - sum(want.values())) <= 2 * len(want) + 2  # a cut rounds down
        again = mixing.decide(mixing.sized(df)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.decide(mixing.sized(empty)).count() == 0


def test_mix_rows(small, odd, empty):
    texts = {r.doc_id: r.text for r in small.collect()}
    want = {r.doc_id: r.taken for r in mixing.decide(mixing.sized(small)).collect()}
    got = collections.Counter()
    mixed = mixing.mix(small)
    assert mixed.columns == small.columns
    for r in mixed.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] += len(words(r.text))
    assert all(got[i] == want[i] for i in want)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() > 0 and mixing.mix(empty).count() == 0


def test_mixing_of_rows_without_ids(spark):
    """Null and repeated ids, equal rows in the cut: each source takes its target to the word."""
    rows = [(None, f"w{i} " * (1 if i % 2 else 1000), "a") for i in range(400)] + [(1, "x " * 700, "b")] * 300 + [(None, "y", "c")] * 500 + [(2, f"z{i} " * (i % 7), "c") for i in range(100)] + [(3, None, "d"), (4, "", None), (5, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = water_fill(sizes)
    for partitions in (1, 7):
        sized = mixing.sized(docs.repartition(partitions))
        got = mixing.decide(sized)
        # the source comes back by its size, which differs here
        taken = collections.Counter()
        for r in got.collect():
            taken[r.source_size] += r.taken
            assert 0 <= r.taken <= 2 * r["size"]
        assert taken == collections.Counter({sizes[s]: int(want[s] + 1e-9) for s in sizes})
        mixed = mixing.mix(docs.repartition(partitions))
        out = collections.Counter()
        for r in mixed.collect():
            out[r.source] += len(words(r.text))
        assert {s: out[s] for s in sizes} == {s: int(want[s] + 1e-9) for s in sizes}


def test_mixing_sql_with_null_and_repeated_ids(spark, tmp_path):
    """The query against its SQL on a table with null ids, repeated ids and equal rows."""
    import duckdb

    rows = [(None if i % 5 == 0 else i // 3, f"w{i % 40} " * (i % 11), "abc"[i * i % 3] if i % 17 else None) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in mixing.op5_mix_sources(spark, str(tmp_path)).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == collections.Counter(c.execute(f"select doc_id, size, source_size, round(target, 6), taken from ({mixing.OP5_SQL})").fetchall())


# --- packing ------------------------------------------------------------------------


def test_packing_round_trip(odd, empty, small):
    for df in (odd, small):
        packed = packing.pack(df, seq_len=256, group_bytes=100_000).collect()
        parts = collections.defaultdict(list)
        for r in packed:
            assert len(r.input_ids) == len(r.position_ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            assert len(r.cu_seqlens) == len(r.doc_ids) + 1
            for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.parts):
                assert list(r.position_ids[a:b]) == list(range(b - a))
                parts[d, p].append(list(r.input_ids[a:b]))
        e = packing.encoding(packing.VOCABULARY)
        want = collections.defaultdict(list)
        for r in df.collect():
            ids = e.encode_ordinary(r.text or "")
            for p, k in enumerate(range(0, len(ids), 256)):
                want[r.doc_id, p].append(ids[k : k + 256])
        assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
        assert len({r.pack_id for r in packed}) == len(packed)
    assert packing.pack(empty).count() == 0


def test_best_fit_is_best():
    import random

    rng = random.Random(3)
    for _ in range(30):
        cap = rng.randint(5, 60)
        lengths = sorted((rng.randint(1, cap) for _ in range(150)), reverse=True)
        where, n = packing.best_fit(lengths, cap)
        room = []
        for x in lengths:
            fit = min((r for r in room if r >= x), default=None)
            if fit is None:
                room.append(cap - x)
            else:
                room[room.index(fit)] = fit - x
        used = [0] * n
        for x, k in zip(lengths, where):
            used[k] += x
        assert sorted(cap - u for u in used) == sorted(room)


def test_long_texts_encode_as_a_whole():
    t = "aé b c\n\n d word 12 " * 70_000
    assert packing.encode(t).tolist() == packing.encoding(packing.VOCABULARY).encode_ordinary(t)


def test_packed_binary(small):
    import numpy as np

    packed = packing.pack(small, seq_len=512)
    rows = {r.pack_id: r for r in packed.collect()}
    for r in packing.binary(packed).collect():
        p = rows[r.pack_id]
        assert np.frombuffer(r.ids, "<u2").tolist() == list(p.input_ids)
        assert np.frombuffer(r.cu_seqlens, "<i4").tolist() == list(p.cu_seqlens)
        assert np.frombuffer(r.position_resets, "<i4").tolist() == list(p.cu_seqlens)[:-1]


def test_packed_bytes_give_the_tokens_back(odd, small):
    """What the query writes: ids, cumulative lengths and resets, decoded against the tokeniser."""
    import numpy as np

    for df in (odd, small):
        got = collections.defaultdict(list)
        for r in packing.matrices(df, seq_len=128, group_bytes=50_000).collect():
            ids, cu, resets = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.cu_seqlens, "<i4").tolist(), np.frombuffer(r.position_resets, "<i4").tolist()
            assert len(ids) == 128 and resets == cu[:-1] and cu[-1] == r.n_tokens and len(resets) == r.n_segments == len(r.doc_ids)
            assert not ids[r.n_tokens :].any()
            for lo, hi, d, p in zip(cu, cu[1:], r.doc_ids, r.parts):
                got[d, p].append(ids[lo:hi].tolist())
        e = packing.encoding(packing.VOCABULARY)
        want = collections.defaultdict(list)
        for r in df.collect():
            ids = e.encode_ordinary(r.text or "")
            for p, k in enumerate(range(0, len(ids), 128)):
                want[r.doc_id, p].append(ids[k : k + 128])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_equal_rows_spread_over_groups(spark):
    text = "The same short row stands in this table again and again."
    rows = spark.range(100_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit(1).alias("grp"), F.lit("k").alias("h"))
    per = [r["count"] for r in packing.parts(rows, 64).groupBy("grp").count().collect()]
    assert len(per) == 64 and sum(per) == 100_000 and max(per) < 2 * 100_000 / 64
    one = spark.createDataFrame([(1, "a b c d e f g h " * 60_000)], "doc_id long, text string")
    per = [r["count"] for r in packing.parts(one, 8, seq_len=64).groupBy("grp").count().collect()]
    assert len(per) == 8


# --- decontamination ----------------------------------------------------------------

QUESTION = "If Alice buys 12 apples and gives Bob 5 apples after walking 3 miles to the market square then how many apples does Alice have left before Bob returns home again"


def test_decontamination_kinds(spark, empty):
    swap = QUESTION.replace("Alice", "Maria").replace("Bob", "Pedro").replace("12", "47").replace("5", "8").replace("3 miles", "9 km")
    mixed = re.sub("Alice|Bob", lambda m, n=iter("Ann Ben Cid Dan Eve".split()): next(n), QUESTION)
    docs = spark.createDataFrame(
        [(1, "Hello there. " + QUESTION + " more words"), (2, "Something else. " + swap), (3, QUESTION.upper()), (4, mixed), (5, None), (6, ""), (None, QUESTION), (7, QUESTION[:60]), (8, " ".join(f"{w}###" for w in QUESTION.split())), (9, "and so on and " + QUESTION[0].lower() + QUESTION[1:])],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, QUESTION), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.matches(docs, items).collect()}
    assert got == {(1, 7): "verbatim", (2, 7): "reparameterised", (3, 7): "verbatim", (None, 7): "verbatim", (8, 7): "verbatim", (9, 7): "verbatim"}
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {4, 5, 6, 7, None}
    assert decontamination.matches(empty, items).count() == 0
    assert decontamination.matches(docs, items.limit(0)).count() == 0


def test_decontamination_of_every_copy(spark):
    swap = QUESTION.replace("Alice", "Maria").replace("Bob", "Pedro").replace("12", "47").replace("5", "8").replace("3 miles", "9 km")
    mixed = re.sub("Alice|Bob", lambda m, n=iter("Ann Ben Cid Dan Eve".split()): next(n), QUESTION)
    gap = " some words of no question stand between the two copies of this bank here "
    nearly = " ".join(QUESTION.split()[:-3])
    short = "add {} apples and then count {} pears"
    bank = " ".join(short.format(a, b) for a, b in ((31, 5), (44, 6), (58, 9), (63, 2)))
    docs = spark.createDataFrame([(1, mixed + gap + swap), (2, mixed + gap + nearly), (3, mixed + gap + mixed), (4, bank), (5, bank), (5, bank), (None, mixed + gap + swap)], "doc_id long, text string")
    items = spark.createDataFrame([(7, QUESTION), (8, short.format(12, 7))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.matches(docs, items).collect()}
    assert got == {(1, 7): "reparameterised", (2, 7): "verbatim", (4, 8): "reparameterised", (5, 8): "reparameterised", (None, 7): "reparameterised"}


def test_decontamination_without_punctuation(spark):
    item = "Then the court ruled on it. Nobody there had seen the letter. Such cases are rare! Who wrote it then? Maybe the clerk did."
    docs = spark.createDataFrame([(1, "a b c " + re.sub(r"[^\w\s]", "", item)), (2, item.lower()), (3, item.replace(". ", ".\n\n")), (4, "Then the court ruled on other things. Such cases are rare!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(docs, items).collect()} == {1, 2, 3}


def test_decontamination_without_filter(spark, small, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = set(map(tuple, decontamination.matches(small, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontamination, "FILTER_ROWS", 0)
    assert set(map(tuple, decontamination.matches(small, items).select("doc_id", "item_id").collect())) == a
    texts = {r.doc_id: r.text for r in small.collect()}
    assert a == {(d, r.item_id) for r in items.collect() for d, t in texts.items() if r.text in t}


def test_decontamination_in_pieces(monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK", 1000)
    monkeypatch.setattr(decontamination, "OVERLAP", 200)
    text = " ".join(f"w{i}" for i in range(2000))
    find = re.compile(decontamination._TOKEN).findall
    whole = decontamination._windows([text], decontamination._Words(), find)[0]
    parts = [decontamination._windows([p], decontamination._Words(), find)[0] for p in decontamination._pieces(text)]
    assert set(whole.tolist()) <= {x for p in parts for x in p.tolist()}


def test_decontamination_judges_rows(spark):
    """Two halves under one id, or under none, are no copy; a row is judged by its own text."""
    w = QUESTION.split()
    head, tail = " ".join(w[:16]), " ".join(w[14:])
    clean = "Nothing in this row has ever been asked in any benchmark that we know of."
    docs = spark.createDataFrame([(1, head, 5), (1, tail, 6), (None, head, 7), (None, tail, 8), (2, clean, 9), (2, QUESTION, 10), (None, QUESTION, 11), (None, clean, 12)], "doc_id long, text string, row long")
    items = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in decontamination.matches(docs, items).collect()}
    assert got == {(2, 7): ("verbatim", 1.0), (None, 7): ("verbatim", 1.0)}
    assert sorted(r.row for r in decontamination.clean(docs, items).collect()) == [5, 6, 7, 8, 9, 11, 12]
    assert sorted(r.row for r in decontamination.clean(docs, items, null_ids=True).collect()) == [5, 6, 7, 8, 9, 12]
    # two items under one id do not add up either
    halves = spark.createDataFrame([(7, head), (7, tail)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(docs.where("row in (5, 9)"), halves).collect()} == {1}


def test_decontamination_of_scripts_without_spaces(spark):
    item = "小明有十二个苹果，他给了小红五个，然后又从市场上买了三个，请问小明现在一共有多少个苹果？"
    docs = spark.createDataFrame([(1, "前面有一些别的话。" + item + "后面也有。"), (2, "这里没有任何题目，只有一些普通的句子，和题目毫无关系。"), (3, item[:15])], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in decontamination.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "verbatim"}


def test_decontamination_of_items_without_templates(spark):
    items = spark.createDataFrame([(1, "Compute 12 + 30 * 4 - 9 now"), (2, "Anna Berta Carla Dora Emma Frieda Gerda Hanna")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "We were told: compute 12 + 30 * 4 - 9 now, and so we did."), (2, "Compute 13 + 30 * 4 - 9 now"), (3, "ANNA BERTA CARLA DORA EMMA FRIEDA GERDA HANNA"), (4, "1 2 3 4 5 6 7 8 9"), (5, "Otto Paul Rolf Sven Timm Udo Veit Wim")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()} == {(1, 1), (3, 2)}


def test_decontamination_over_piece_borders(spark, monkeypatch):
    """A long item in a long text is verbatim wherever it stands, and positions run on over pieces."""
    import random

    monkeypatch.setattr(decontamination, "CHUNK", 3000)
    monkeypatch.setattr(decontamination, "OVERLAP", 100)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    item = " ".join(f"{word()} 17 {word()}" if i % 9 == 0 else word() for i in range(900))
    fill = [" ".join(word() for _ in range(n)) for n in (0, 30, 400, 1100, 2000)]
    docs = spark.createDataFrame([(i, f"{f} {item} {f}") for i, f in enumerate(fill)] + [(9, "x" * 20_000 + " " + item), (10, "字" * 9000 + item)], "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.coverage) for r in decontamination.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i: ("verbatim", 1.0) for i in (0, 1, 2, 3, 4, 9, 10)}
    find = re.compile(decontamination._TOKEN).findall
    for text in (fill[4], "字" * 9000, "a " * 5000, "x" * 20_000 + " b c"):
        whole = find(text)
        for before, piece in decontamination._placed(text, find):
            assert find(piece) == whole[before : before + len(find(piece))]
        assert before + len(find(piece)) == len(whole)


def reference(doc, item):
    """(coverage, consistency, kind) of the only copy in ``doc``, by plain loops; None if it holds none."""

    def parse(text):
        toks, out = re.findall(r"\d+(?:[.,:/]\d+)*(?![^\W\d_])|[^\W_]+", text), []
        for i, w in enumerate(toks):
            low = w.lower()
            if low in decontamination.NUMBER_WORDS or w[0].isdigit():
                out.append(("NUM", low))
            elif low in decontamination.UNITS and i and out[-1][0] == "NUM":
                out.append(("UNIT", low))
            elif low not in decontamination.UNITS and len(w) > 1 and w[0].isupper() and not w.isupper():
                out.append(("NAME", low))
            else:
                out.append((low, None))
        return out

    def windows(toks):
        out = {}
        for i in range(len(toks) - 4):
            if sum(v is None for _, v in toks[i : i + 5]) >= 3:
                out.setdefault(tuple(k for k, _ in toks[i : i + 5]), []).append(i)
        return out

    best = None
    for text in {item, item.lower()}:
        a, d = parse(text), parse(doc)
        mine, theirs = {k: v[0] for k, v in windows(a).items()}, windows(d)
        if len(mine) > 1 and text[0].isupper():
            mine = {k: i for k, i in mine.items() if i}
        shared = [k for k in mine if k in theirs]
        if not shared or len(shared) / len(mine) < 0.8:
            continue
        pairs, equal = set(), 0
        for k in shared:
            same = False
            for p in theirs[k]:
                slots = [(mine[k] + j, a[mine[k] + j][1], d[p + j][1]) for j in range(5) if a[mine[k] + j][1] is not None]
                pairs |= set(slots)
                same |= all(x == y for _, x, y in slots)
            equal += same
        counts = collections.defaultdict(collections.Counter)
        for _, x, y in pairs:
            counts[x][y] += 1
        agree = min((max(c.values()) / sum(c.values()) for c in counts.values()), default=1.0)
        kind = "verbatim" if equal / len(mine) >= 0.8 else "reparameterised"
        if kind == "verbatim" or agree >= 0.8:
            best = max(filter(None, (best, (len(shared) / len(mine), agree, kind))))
    return best


def test_decontamination_against_plain_loops(spark):
    """Template windows, coverage and slot consistency of random questions and their changed copies."""
    import random

    rng = random.Random(8)
    words_ = [f"{a}{b}" for a in "ban cor dil fen gos hul jem kip lor mun".split() for b in "ta re mo si lu nea".split()]
    names, units = "Alice Bruno Carla Denis Elena Felix Greta Hugo".split(), ["km", "kg", "hours"]

    def question():
        out, who, n = [], rng.sample(names, 2), [str(rng.randint(2, 90)) for _ in range(2)]
        for i in range(rng.randint(14, 34)):
            r = rng.random()
            out.append(rng.choice(who) if r < 0.12 else f"{rng.choice(n)} {rng.choice(units)}" if r < 0.18 else rng.choice(n) if r < 0.25 else rng.choice(words_))
        return " ".join(out)

    items = [question() for _ in range(25)]
    docs = []
    for k in range(160):
        q = items[k % 25]
        if k % 4 == 1:
            change = {n: m for n, m in zip(names, rng.sample(names, 8))}
            q = " ".join(change.get(w, str(int(w) + 100) if w.isdigit() else w) for w in q.split())
        elif k % 4 == 2:
            q = " ".join(rng.choice(names) if w in names else str(rng.randint(2, 99)) if w.isdigit() else w for w in q.split())
        elif k % 4 == 3:
            w = q.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words_)
            q = " ".join(w)
        docs.append(f"{' '.join(f'noise{rng.randrange(10**6)}' for _ in range(12))} {q} {' '.join(f'other{rng.randrange(10**6)}' for _ in range(9))}")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), round(r.consistency, 9), r.kind) for r in decontamination.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(i, j): (round(m[0], 9), round(m[1], 9), m[2]) for i, d in enumerate(docs) for j, t in enumerate(items) if (m := reference(d, t))}
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()} and len(want) > 80
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {v[2] for v in want.values()} == {"verbatim", "reparameterised"}


# --- classifier ---------------------------------------------------------------------


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    import zlib

    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_classifier_odd_rows(spark, odd, empty):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (8, 0, 0), (11, 0, 0), (12, 0, 0), (4, None, 0), (None, 1, 0), (99, 0, 0), (1, 1, 0)], schema)
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality_classifier.classify(odd, some).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert quality_classifier.classify(empty, labels).count() == 0


def test_classifier_scores_are_densities():
    import numpy as np

    rng = np.random.default_rng(0)
    d = len(quality_classifier.FEATURES)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(1, 2, (900, d))}
    one = {c: np.c_[np.ones(len(v)), v] for c, v in x.items()}
    m = quality_classifier.Model({c: v.T @ v for c, v in one.items()}, pooled=0, ridge=0, temperature=1)
    both = np.concatenate(list(x.values()))
    p = both[:50]
    log = {}
    for c, v in x.items():
        mean, cov = v.mean(0), np.cov(v.T, bias=True)
        diff = p - mean
        log[c] = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(v) / 1300)
    assert np.allclose(m.score(p), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)
