"""Operators with Python in their tasks, against brute force, round trips and held-out accuracy."""

import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalloom.llm import bitsliced_topk, html_text, lm_score, mixing, packing, simhash_dedup, token_files, token_ids, toxicity
from evalloom.llm.token_ids import encoder
from evalloom.storage import scratch_path
from tests_llm_plain import plain_components, plain_simhash

FILE = public_tokenizers.path("byte_bpe_50k.json")


# --- near duplicates ---------------------------------------------------------------------
def test_fingerprints_and_groups(odd, none):
    rows = odd.collect()
    prints = [plain_simhash(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], prints, plain_components([r["doc_id"] for r in rows], prints)), key=repr)
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash_dedup.near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == want
    assert simhash_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("direct", [64, 3])
def test_links_of_crowds(spark, direct):
    """Chains and clouds of near prints; with small buckets every level of splitting is used."""
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(at)
            at ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                at ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(10)} | {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), direct=direct)
    labels = {r["node"]: r["label"] for r in simhash_dedup.components(edges).collect()}
    want = plain_components(range(len(prints)), prints)
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(w, []).append(p)
    for members in groups.values():
        assert len({labels.get(p, p) for p in members}) == 1
        assert labels.get(members[0], members[0]) == min(members)


def test_every_close_pair_shares_a_mask():
    masks = simhash_dedup.covering_masks(list(range(64)), 2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


# --- token ids, packing and files --------------------------------------------------------
def test_ids_equal_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(FILE), encoder(FILE).encode
    rng = random.Random(1)
    parts = [" ", " ", "\n", "a", "bc", "1", "!", "'s", "'", "'re", "é", "ß", "\t", "\x1c", "  ", " \n", "　", "<|endoftext|>", "💩", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_that_cut_otherwise():
    """Ids of a file with a normalizer and another pattern, and of one that puts a space first."""
    other = FILE.replace("byte_bpe_50k", "word_bpe_49k")
    tokenizer, made = Tokenizer.from_file(other), encoder(other)
    assert not made.cuts and encoder(FILE).cuts
    for text in ("", "Hello  World's 123 end.", "a\nb", "É é"):
        assert np.frombuffer(made.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    with open(FILE, encoding="utf-8") as file:
        said = json.load(file)
    said["pre_tokenizer"]["add_prefix_space"] = True
    assert not token_ids._says(said, token_ids._CUT)


def test_dictionary_sees_whole_texts(spark, monkeypatch):
    """Blocks that the dictionary is trained on come from all places of long texts."""
    seen = []
    monkeypatch.setattr(token_files.zstandard, "train_dictionary", lambda size, samples: seen.extend(samples) or 1 / 0)
    docs = spark.createDataFrame([(i, f"start {i} " + "word " * 9_000 + f"ending{i}") for i in range(5)], "doc_id long, text string")
    with pytest.raises(ZeroDivisionError):
        token_files.train(docs, FILE, 2)
    whole = [token_files.serialized(encoder(FILE).encode(r["text"]), 2) for r in docs.collect()]
    step = token_files.FIT_IDS * 2
    assert sorted(seen) == sorted(w[i : i + step] for w in whole for i in range(0, len(w), step))


def test_local_search_empties_bins():
    bins = packing.Bins([6, 3, 5, 4, 2, 7], 10)
    bins.bins, bins.fill = [[0], [1], [2], [3], [4], [5]], [6, 3, 5, 4, 2, 7]
    while bins.improve():
        pass
    assert len(bins.bins) == 3 and sorted(bins.fill) == [7, 10, 10] or sorted(bins.fill) == [8, 9, 10]
    assert sorted(i for b in bins.bins for i in b) == list(range(6))
    swap = packing.Bins([7, 2, 6, 3], 9)  # 7 2 and 6 3 are best, found from 7 3 impossible, 6 2
    swap.bins, swap.fill = [[2, 1], [0], [3]], [8, 7, 3]
    while swap.improve():
        pass
    assert sorted(swap.fill) == [9, 9]


@pytest.mark.parametrize("seed", range(4))
def test_packed_lengths(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, [2047, 300, 1100, 900][seed]) for _ in range(1500)]
    where, offset, fill = packing.pack_lengths(lengths, 2048)
    rows = sorted(zip(where, offset, lengths, fill))
    ends = Counter()
    for w, o, n, f in rows:
        assert o == ends[w]
        ends[w] += n
    assert all(ends[w] == f <= 2048 for w, _, _, f in rows)
    assert len(ends) <= -(-sum(lengths) // 2048) * 1.02 + 1


def test_pieces_and_packing(odd, none, spark):
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for r in odd.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]
        want += [(r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(cuts)]
    packed = packing.pack(packing.pieces(odd, FILE, keep_ids=True))
    rows = packed.collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for key, parts in by_sequence.items():
        at = 0
        for offset, length, ids in sorted(parts):
            assert offset == at and whole[key][at : at + length] == ids
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack(packing.pieces(none, FILE)).count() == 0


def test_files_round_trip(odd, none, documents, spark):
    tokenizer = Tokenizer.from_file(FILE)
    for df in (odd, none, documents.limit(150)):
        path = scratch_path(spark, "test-files")
        token_files.write(df, path, FILE)
        got = sorted((tuple(r) for r in token_files.read(spark, path).collect()), key=lambda r: (r[1], r[2]))
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        start, ids = 0, []
        for r in rows:
            ids.append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
        assert [g[0] for g in got] == [r["doc_id"] for r in rows]
        assert sorted((g[0] is None, g[0], g[2], g[3]) for g in got if g[0] is not None) == sorted(
            (r[0] is None, r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids) if r[0] is not None
        )
        for g in got:
            assert g[1] == start
            start += g[2]
        assert start == sum(map(len, ids))
        wanted = spark.createDataFrame([(5,), (7,)], "doc_id long")
        fetched = {r["doc_id"]: r["ids"] for r in token_files.fetch(spark, path, wanted).collect()}
        for r, i in zip(rows, ids):
            if r[0] in (5, 7):
                assert fetched[r[0]] == i


# --- exact top-k -------------------------------------------------------------------------
def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 16]) for i in range(400)]
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [1e300] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors += [(405, []), (406, [0.5, 0.5]), (7, vectors[7][1]), (7, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and abs(x) < 1e9 for x in v)]
    asked = {}
    for i, v in usable:
        if i % 50 == 0 or i in (7, 405, 406):
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    queries = df.where("vec_id % 50 = 0 OR vec_id IN (7, 405, 406)")
    assert sorted(map(tuple, bitsliced_topk.top_k(df, queries).collect())) == sorted(want)
    assert bitsliced_topk.top_k(df.where("false"), queries.where("false")).count() == 0
    assert bitsliced_topk.top_k(df.where("vec_id = 50"), queries).where("query_id = 50").count() == 0


# --- mixing ------------------------------------------------------------------------------
def plain_targets(sizes, weights, total, most=2.0):
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        left = total - sum(target[s] for s in sizes if s not in free)
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= most * sizes[s]}
        if not over:
            return {**target, **{s: level * weights[s] for s in free}}
        for s in over:
            target[s] = most * sizes[s]
        free -= over
    return target


def test_mixture(documents, odd, none):
    for df in (documents, odd):
        mixed = mixing.mix(df, keep=["doc_id", "text"])
        rows = mixing.taken_words(mixed).collect()
        plain = [(r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in df.collect()]
        assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((d or -1, n) for d, n, _ in plain)
        sizes = Counter()
        for _, n, s in plain:
            sizes[s] += n
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        target = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
        known = {r["source"]: (r["source_size"], r["target"], r["sid"]) for r in mixed.sources.collect()}
        for s in names:
            assert known[s][0] == sizes[s] and math.isclose(known[s][1], target[s], rel_tol=1e-9, abs_tol=1e-6)
        sid = {r["row"]: r["sid"] for r in mixed.documents.select("row", "sid").collect()}
        taken = Counter()
        for r in mixed.rows.collect():
            taken[sid[r["row"]]] += r["words"]
        assert all(abs(taken[i] - t) <= 1 for _, t, i in known.values())
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.taken_words(mixing.mix(df)).collect()), key=repr)
        cut = mixing.mixed_documents(mixed, "text", ["doc_id", "text"]).collect()
        assert sum(len(r["text"].split()) for r in cut) == sum(r["taken"] for r in rows)
        whole = Counter()
        for r in df.collect():
            whole[r["doc_id"]] = f"{whole[r['doc_id']] or ''}{r['text']}"
        assert all(r["text"] in whole[r["doc_id"]] for r in cut)
        places = sorted((r["place"]["shard"], r["place"]["position"]) for r in cut)
        ends = Counter(s for s, _ in places)
        assert places == [(s, i) for s in sorted(ends) for i in range(ends[s])]
    assert mixing.taken_words(mixing.mix(none)).count() == 0


def test_order_by_ranges(spark):
    """Ranks and running sums over many ranges are those of one sorted list; nulls last, ties by the second key."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *"abcdefghij"]), i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, x long").repartition(7)
    for frame in (df, df.where("i = 3"), df.where("false")):
        got = mixing._in_order(frame, [F.col("k").asc_nulls_last(), F.col("i").asc()], ["x"], "test-order").collect()
        want = sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        assert sorted(r["_rank"] for r in got) == list(range(len(want)))
        for r in got:
            assert want[r["_rank"]] == (r["k"], r["i"], r["x"])
            assert r["_before_x"] == sum(w[2] for w in want[: r["_rank"]])


def test_rows_without_ids_are_spread(spark):
    """Null and equal ids fill many chunks instead of one."""
    n = 3 * mixing.CHUNK
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(rows)
    sizes = [r["count"] for r in mixed.documents.groupBy("_chunk").count().collect()]
    assert len(sizes) == 3 and max(sizes) < 1.2 * mixing.CHUNK
    assert all(0 <= r["taken"] <= 10 for r in mixing.taken_words(mixed).collect())


def test_tree_is_exact():
    rng = np.random.default_rng(1)
    draws = rng.integers(0, 60, 64)
    members = {g: rng.multinomial(n, [0.5, 0.2, 0.3]) for g, n in enumerate(draws)}
    shards = 37
    held = np.zeros(shards, int)
    for g, own in members.items():
        seen = np.zeros(3, int)
        parts = [*mixing.leaf_quotas(draws, g, own, shards, 0, 20), *mixing.leaf_quotas(draws, g, own, shards, 20, shards)]
        for leaf, quota, before in sorted(parts, key=lambda x: x[0]):
            assert (before == seen).all()
            seen += quota
            held[leaf] += quota.sum()
        assert (seen == own).all()
    total = int(draws.sum())
    assert held.tolist() == [(i + 1) * total // shards - i * total // shards for i in range(shards)]


# --- toxicity ----------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(documents, spark, sf_dir, odd, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled, share = toxicity.labelled_sample(documents, labels)
    model = toxicity.fit(labelled, share)
    scored = toxicity.score(documents, model).join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id")
    rows = [(r["doc_id"], r["toxicity"], r["toxic"]) for r in scored.select("doc_id", "toxicity", "toxic").collect()]
    held = [(s, t) for d, s, t in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum((s >= 0.3) == (t == 1) for s, t in held) / len(held) > 0.9
    assert all(0 <= s <= 1 for _, s, _ in rows)
    out = toxicity.score(odd, model, score_col="score")
    assert out.columns == [*[c for c in odd.columns if c != "score"], "score"] and out.where("score IS NULL").count() == 0
    assert out.count() == odd.count() and toxicity.score(none, model).count() == 0
    assert {r["toxicity"] for r in toxicity.rate(odd, labels.where("false")).collect()} == {0.0}


def test_dictionary_follows_the_lexicon(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}slurword{i}" for i in range(300)]
    rng = random.Random(3)
    plain = [" ".join(f"plain{rng.randrange(500)}" for _ in range(60)) for _ in range(600)]
    labelled = [(i, 0, i % 3 == 0, t.encode()) for i, t in enumerate(plain)]
    for i in range(600):
        line = plain[i].split()
        for j in range(0, 60, 3):
            line[j] = words[rng.randrange(300)]
        labelled.append((1_000 + i, 1, i % 3 == 0, " ".join(line).encode()))
    texts = spark.createDataFrame([r for r in labelled if not r[2]], "id long, toxic int, probe boolean, text binary")
    toxic, _ = toxicity.dictionaries(texts)
    assert sum(w.encode() in toxic for w in words) > 200  # 1,300 bytes hold some 100 of them


def test_toxic_phrases_of_ordinary_words(spark):
    rng = random.Random(4)
    line = lambda: [f"plain{rng.randrange(300)}" for _ in range(80)]
    phrases = [" ".join(f"plain{rng.randrange(300)}" for _ in range(5)) for _ in range(6)]
    rows = []
    for i in range(900):
        words = line()
        for _ in range(4 if i % 3 == 1 else 0):
            words.insert(rng.randrange(80), rng.choice(phrases))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(900)], "doc_id long, toxic int")
    held = [(r["toxicity"] >= 0.3, r["doc_id"] % 3 == 1) for r in toxicity.rate(docs, labels).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.9


def test_gains_are_plain_differences(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice("aa bb cc dd ee vile foul plain words here".split()) for _ in range(200)).encode()
    toxic, ordinary = b" vile foul " * 20 + text[:300], b" plain words here " * 20 + text[:300]
    buffer, segments, _ = toxicity.window_segments([text], 8)

    def plain(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=toxicity.LEVEL)
        options = {"level": toxicity.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return len(zstandard.ZstdCompressor(dict_data=held, **options).compress(window))

    parts = [buffer[a : a + n] for a, n in segments.tolist()]
    want = [plain(p, ordinary) - plain(p, toxic) for p in parts]
    assert len(parts) == 25 and toxicity.Meter(toxic, ordinary).gains(buffer, segments).tolist() == want
    rows = spark.createDataFrame([(0, p) for p in parts], "part int, passage binary")
    kept = [bytes(r["passage"]) for r in toxicity.telling(rows, [(toxic, ordinary), (ordinary, toxic)]).collect()]
    assert sorted(kept) == sorted(p for p, g in zip(parts, want) if g >= toxicity.SAVES)


def test_passages_are_distinct(spark):
    rows = [(i, 1, f"a b c d e f g h own{i}".encode()) for i in range(20)] + [(30, 1, b""), (31, 0, b"x y")]
    texts = spark.createDataFrame(rows, "id long, toxic int, text binary")
    got = [bytes(r["passage"]) for r in toxicity.passages(texts, 1, 4).collect()]
    assert sorted(got) == sorted([b" a b c d ", b" e f g h ", *[f" own{i} ".encode() for i in range(20)]])
    empty = spark.createDataFrame([(1, 1, b""), (2, 0, b"")], "id long, toxic int, text binary")
    assert toxicity.Meter(*toxicity.dictionaries(empty)).features([b"", b"a b"]).shape == (2, toxicity.FEATURES)


def test_fit_sees_the_ends_of_long_texts(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    filler = " ".join(f"plain{i % 50}" for i in range(2_000))
    rows = [(i, f"{filler} {' '.join(f'x{i} vile{k} y{i}' for k in range(5))}" if i % 2 else filler) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.rate(docs, labels).select("doc_id", "toxicity").collect()
    assert all((r["toxicity"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_windows_cover_whole_texts():
    text = b"A bc  def\n" * 100
    buffer, segments, counts = toxicity.window_segments([text, b"", b" x "], 16)
    assert counts.tolist() == [19, 0, 1]
    parts = [buffer[a : a + n] for a, n in segments.astype(int).tolist()]
    assert b"".join(p[:-1] for p in parts).split() == (text.lower() + b" x").split()


# --- pages -------------------------------------------------------------------------------
PAGES = [
    ("<html><body><nav><ul><li>a b c d e f</li></ul></nav><div class='cookie-notice'>we use many cookies here today</div><article><h1>T &amp; U</h1><p>one  two\nthree<br>four</p><p>x.</p></article><footer>all rights of ours are reserved</footer></body></html>", "T & U\none two three four\nx."),
    ("<p>only text<script>var t='</p>';</script> here</p><!-- no --><p>and &lt;b&gt; that", "only text here\nand <b> that"),
    ("", ""),
    (None, ""),
    ("<div></div>", ""),
    ("plain & simple", "plain & simple"),
    ("<article><p>main words of the text stand here</p><section id=comments><p>first!</p></section></article>", "main words of the text stand here"),
]


def test_main_texts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = html_text.learned(pages)
    assert weights["/article"] < -1 and all(w < 0 for w in weights.values())
    for page, want in PAGES:
        assert html_text.extract(page or "", weights) == want
    df = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, None)], "page_id long, main_text string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_text.main_text(df).collect()}
    assert got[2] == "" and got[3] == "" and got[None] == "" and html_text.main_text(df.where("false")).count() == 0


W60, W40, W20 = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 40), ("c", 20)))


@pytest.mark.parametrize("page, want", [
    (f"<html><body class='home no-sidebar'><p>{W60}</p></body></html>", W60),
    (f"<body><article class='post comments-enabled'><p>{W60}</p></article></body>", W60),
    (f"<div class='page header-fixed'><p>{W60}</p></div>", W60),
    (f"<form action='/'><p>{W60}</p></form>", W60),
    (f"<article><p>{W40}</p><section class='related-work'><p>{W20}</p></section></article>", f"{W40}\n{W20}"),
    (f"<article><p>{W60}</p><section class='related-posts'><a href='/'>{W20}</a></section></article>", W60),
    (f"<article><p>{W60}</p></article><div class='comment-list'><p>{W40}</p></div>", W60),
    (f"<article><p>{W60}</p><div class='ad'>{W20}</div></article>", W60),
    (f"<article><p>{W60}</p><form class='search'><p>{W20}</p></form></article>", W60),
    ("<nav><a href='/'>家 目次</a></nav><article><p>" + "文字列" * 30 + "</p></article>", "文字列" * 30),
])
def test_hints_leave_articles(page, want, spark, sf_dir):
    weights = html_text.learned(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert html_text.extract(page, weights) == want
    assert html_text.extract(page, {}) == want  # also where no page could be learned from


def test_very_long_and_repeated_pages(spark):
    body = "".join(f"<p>{W60}</p>" for _ in range(4_000))  # 1 MB
    page = f"<body><nav>{W20}</nav><article>{body}</article></body>"
    df = spark.createDataFrame([(1, page), (1, page), (2, f"<p>{W20}</p><table><tr><td>{W20}</td></tr></table>" * 2)], "page_id long, html string")
    got = [r["main_text"] for r in html_text.main_text(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == "\n".join([W60] * 4_000)
    assert got[2] == "\n".join([W20] * 4)


def test_fit_reads_whole_pages():
    """The article of a page whose start alone is longer than usual pages is learned from."""
    page = f"<body><div class='x'>{W20 * 4_000}</div><article><p>{W60}</p></article></body>"
    hinted, plain = html_text.lines(page)
    assert any(marked and words == 60 for _, words, marked in hinted) and html_text.fit([(hinted, plain)] * 4)


@pytest.mark.parametrize("seed", range(20))
def test_stretch_is_the_best(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 0]) for _ in range(rng.randrange(12))]
    a, b = html_text.best_stretch(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
    assert sum(scores[a:b]) == max(best, 0)


# --- language model ----------------------------------------------------------------------
def test_model_scores(documents, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 2_000)
    rows = {r["doc_id"]: r for r in lm_score.score(documents, rounds=1).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in documents.collect()}
    counts = Counter(w for d, ws in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    total = sum(counts.values())
    for d, ws in texts.items():
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)
        assert math.isclose(rows[d]["base_score"], base, rel_tol=1e-9) and rows[d]["train_tokens"] == total
        assert (rows[d]["n_tokens"], rows[d]["n_known"]) == (len(ws), sum(counts[w] > 0 for w in ws))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_are_plain_sums(documents, monkeypatch):
    """Every token's log probability, by a softmax of its own and the counts of its class, added up."""
    kept, fit, vocabulary = {}, lm_score.fit, lm_score.vocabulary
    monkeypatch.setattr(lm_score, "HEAD", 500)
    monkeypatch.setattr(lm_score, "fit", lambda *a, **k: kept.setdefault("p", fit(*a, **k)))
    monkeypatch.setattr(lm_score, "vocabulary", lambda counts: kept.setdefault("v", vocabulary(counts)))
    docs = documents.limit(60)
    rows = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    counts = Counter(w for d, ws in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    p, vocab = kept["p"], kept["v"]
    members = {}  # the words of a class are all that share it
    for w in counts:
        members.setdefault(int(lm_score.classes_of([w], vocab)[0][0]), []).append(w)
    single = lm_score.FIRST + min(lm_score.OWN, len([w for w in vocab.head if w]))
    for d in sorted(texts)[:15]:
        far = near = lm_score.BEGIN
        total = 0.0
        for w in [*texts[d], b""]:
            k = int(lm_score.classes_of([w], vocab)[0][0]) if w else lm_score.END
            logits = p.target @ (p.context[near] * p.near + p.context[far] * p.far) + p.bias
            total += (logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            if k >= single:
                own = [counts[m] for m in members.get(k, [])]
                total += math.log10((counts[w] + 1) / (sum(own) + len(own) + 1))
            far, near = near, k
        assert math.isclose(rows[d]["score"], total, rel_tol=1e-6)


def test_model_is_normalised(documents):
    texts = lm_score._texts(documents.limit(200), "doc_id", "text")
    counts = lm_score.word_counts(texts).cache()
    vocab = lm_score.vocabulary(counts)
    predict = lm_score.Predictor.of(lm_score.fit(texts, vocab, rounds=1))
    size = len(vocab.class_tokens)
    for far, near in ((1, 1), (5, 9), (size - 1, 3)):
        mass = [10 ** predict.log10(np.array([far, near, k]))[0] for k in range(size)]
        assert math.isclose(sum(mass), 1, rel_tol=1e-6)
    inside = Counter()
    for r in counts.collect():
        classes, _, _ = lm_score.classes_of([bytes(r["word"])], vocab) if r["word"] else ([0], None, None)
        inside[int(classes[0])] += r["c"]
    assert {k: v for k, v in enumerate(vocab.class_tokens) if v} == dict(inside)


def test_model_on_odd_rows(odd, none):
    got = lm_score.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm_score.score(none).count() == 0
    alone = odd.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert all(r["n_known"] == 0 for r in lm_score.score(alone).collect())


def test_every_training_token_is_a_target(spark, monkeypatch):
    def counted(p, squares, triples, noise, log_noise):
        np.add.at(p.bias, triples[:, 2], 1)

    monkeypatch.setattr(lm_score, "train_step", counted)
    docs = spark.createDataFrame([(i, "a few words of " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    texts = lm_score._texts(docs, "doc_id", "text")
    vocab = lm_score.vocabulary(lm_score.word_counts(texts))
    before = lm_score.start(vocab)
    after = lm_score.train_round(texts, vocab, before, 0)
    assert np.allclose(after.bias - before.bias, vocab.class_tokens, atol=1e-2)


def test_end_token_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 100)
    n = 300
    docs = spark.createDataFrame([(2, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    assert zlib.crc32(b"2") % 7 != 2
    (row,) = lm_score.score(docs, rounds=1).collect()
    assert row["n_tokens"] == row["n_known"] == n + 1
    assert math.isclose(row["base_score"], (n + 1) * math.log10(2 / (2 * (n + 1) + 1)), rel_tol=1e-9)


def test_large_components_are_kept(spark):
    """Components around 2**27 and beyond take part, exactly; where scores cannot be longs the job fails."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 29), 1 << 29, 6)]) for i in range(60)] + [(60, [float(1 << 19)] * 6), (61, [float(-(1 << 19))] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bitsliced_topk.top_k(df, asked, k=5, scale=1.0).collect()}
    for q, v in rows[::20]:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
        assert [got[(q, r + 1)] for r in range(5)] == [(i, -s) for s, i in scores[:5]]
    with pytest.raises(PySparkException, match="beyond 64 bits"):
        bitsliced_topk.top_k(df, asked, k=5, scale=float(1 << 12)).collect()
