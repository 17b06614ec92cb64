"""Operators with Python in tasks: packing, SimHash, BPE, media; and the pipeline."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreweave.llm import bpe, common, components, media, packing, queries, simhash

from .test_native import SECRET_TEXTS, _quality, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
TEXTS = [None, "", " ", "Hello, it's 12 wörld<|endoftext|> á x Σς", "the cat sat", "The  Cat\tsat", "a b c d e f g " * 3000, "漢字かな😀 'LL x'll <|startoftext|>", "x" * 9000, "the cat sat", "İstanbul ſ K ﬁ́", "\x1c\x85\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAtTeE's'llRE 12.,!?éÉßΣİ\n\t́<|>")), max_size=60))
def test_bpe_like_the_library(text):
    ids = next(bpe.encoder(PATH).encode([text])).tolist()
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == want and bpe.encoder(PATH).decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    e = bpe.encoder(PATH)
    for token in random.Random(1).sample(e.tokens, 3000):
        raw = bytes(e._letter_byte[c] for c in token.removesuffix("</w>") if c in e._letter_byte)
        assert all(e.inside[a, b] for a, b in itertools.pairwise(raw)) or token in e._special


def test_bpe_query(spark):
    rows = {r["doc_id"]: r for r in bpe.bpe_digest(bpe.encode_texts(docs(spark, TEXTS), PATH)).collect()}
    for k, t in enumerate(TEXTS):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(docs(spark, []), PATH).collect() == []
    big = 2**60 + 1
    assert {r["doc_id"] for r in bpe.encode_texts(docs(spark, ["a", "b"], [None, big]), PATH).collect()} == {None, big}


def _fewest(sizes, capacity):
    """The least number of sequences, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, room):
        if len(room) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(room)
            return
        for i in sorted({room.index(r) for r in set(room) if r >= sizes[k]}):
            place(k + 1, [*room[:i], room[i] - sizes[k], *room[i + 1 :]])
        place(k + 1, [*room, capacity - sizes[k]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_reduction_loses_no_sequence(sizes):
    counts = Counter(sizes)
    fixed = packing.reduce_by_dominance(counts, 30)
    left = list(counts.elements())
    assert sum(f.bins for f in fixed) + _fewest(left, 30) == _fewest(sizes, 30)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), min_size=1), st.integers(50, 80))
def test_plan_places_every_rank(counts, capacity):
    ends, ranks = defaultdict(list), Counter()
    for length, first, after, each, sequence, offset in packing.plan(counts, capacity):
        assert ranks[length] == first
        ranks[length] = after
        for r in range(after - first):
            ends[sequence + r // each].append((offset + r % each * length, length))
    assert ranks == counts
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(ends) <= 2 * -(-sum(k * v for k, v in counts.items()) // capacity)


def test_packing(spark):
    cut = packing.cut_documents(docs(spark, TEXTS), PATH, 4096, with_ids=True)
    rows = packing.pack(cut).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for k, t in enumerate(TEXTS):
        want = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[k], key=lambda r: r["piece"])
        assert [i for r in mine for i in r["ids"]] == want and [r["start"] for r in mine] == list(range(0, len(want), 4096))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in mine)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack(cut)).collect()}
    assert max(map(len, whole.values())) <= 4096 and sum(map(len, whole.values())) == sum(r["length"] for r in rows)
    assert len(whole) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack(packing.cut_documents(docs(spark, []), PATH)).collect() == []
    for bad in (None, 0, 5000):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 0, bad)], "doc_id long, piece int, length long"))


def _fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, prints, distance):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_near_copies(spark):
    r = random.Random(3)
    base = [" ".join(r.choice(["the", "of", "cat", "dog", "ran", "sat", "on"]) for _ in range(400)) for _ in range(6)]
    texts = TEXTS + base + [b.replace("cat", "cow", 1) for b in base] + [b + " end" for b in base] + base[:2]
    ids = [*range(50, 50 + len(texts) - 2), None, 3]
    rows = simhash.near_copies(docs(spark, texts, ids)).collect()
    prints = [_fingerprint(t) for t in texts]
    want = Counter((i, p, c) for i, p, c in zip(ids, prints, _components(ids, prints, 2), strict=True))
    assert Counter((x["doc_id"], x["fp"] % 2**64, x["component_id"]) for x in rows) == want
    assert simhash.near_copies(docs(spark, [])).collect() == []
    assert [x["component_id"] for x in simhash.near_copies(docs(spark, ["a", "a"], [None, None])).collect()] == [None, None]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_pigeonhole_finds_all_pairs(spark, distance):
    r = random.Random(distance)
    prints = {r.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for _ in range(3):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))))
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    found = {(x["a"] % 2**64, x["b"] % 2**64) for x in simhash.linked(nodes, distance).collect()}
    want = {frozenset(x) for x in itertools.combinations(prints, 2) if (x[0] ^ x[1]).bit_count() <= distance}
    assert {frozenset(x) for x in found} == want and len(found) == len(want)


@pytest.mark.parametrize("n", [10, 10**7, 10**11])
def test_thresholds_add_up(n):
    sample = np.array([random.Random(1).getrandbits(64) for _ in range(300)], np.uint64)
    for distance in range(6):
        parts = simhash.allocate(sample, n, distance)
        assert sum(p.threshold + 1 for p in parts) == distance + 1
        assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(500, 700), (600, 700)]
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 500: 500, 600: 500, 700: 500}


def test_media(spark):
    texts = [*TEXTS, "z" * 64, "y" * 65]
    rows = {r["doc_id"]: r for r in media.media_digest(media.read_media(media.store_texts(docs(spark, texts)))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (rows[k]["n_bytes"], rows[k]["payload_bytes"]) == (len(raw), len(payload))
        assert rows[k]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[k]["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.write_pictures(payload)
        assert (rows[k]["media_bytes"], rows[k]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.store_texts(docs(spark, [])).collect() == []


def test_rank_without_gaps(spark):
    rows = [(k % 3 if k % 4 else 0, k % 5, k // 2) for k in range(400)]
    ranked = common.gapless_rank(spark.createDataFrame(rows, "g long, part long, v long"), ["g"], "part", ["v"], "rank").collect()
    for g in range(3):
        mine = sorted((r["part"], r["v"], r["rank"]) for r in ranked if r["g"] == g)
        assert [x[2] for x in mine] == list(range(len(mine)))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else "w%03d" % r.randrange(900) for _ in range(n))
    texts = [prose(80) for _ in range(12)] + [t for t in SECRET_TEXTS if t] + [None, "junk ### $$$ " * 40]
    texts += [texts[0], texts[1], texts[2] + " password=hunter22x " + prose(60), prose(3000)]
    ids = [*range(100, 100 + len(texts) - 1), 3]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    kept = []
    stages = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stages, folder)
        assert out.columns == stages.columns
        out.write.parquet(f"{folder}/{name}")
        stages = spark.read.parquet(f"{folder}/{name}")
        kept.append({x["doc_id"]: x["text"] for x in stages.collect()})
    good = [k for k, t in enumerate(texts) if not _quality(t)[-1]]
    assert set(kept[0]) <= {ids[k] for k in good} and set(range(100, 112)) <= set(kept[0])
    left = [k for k in good if ids[k] in kept[0]]
    groups = _components([ids[k] for k in left], [_fingerprint(texts[k]) for k in left], 2)
    assert set(kept[1]) == set(groups)
    assert {100, 101} <= set(kept[1]) and not {ids[-4], ids[-3]} & set(kept[1])
    assert "hunter22x" not in " ".join(kept[2].values()) and set(kept[2]) == set(kept[1])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {x["doc_id"] for x in rows} == set(kept[2])
    for i, t in kept[2].items():
        assert sum(x["length"] for x in rows if x["doc_id"] == i) == len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    prose = " ".join(r.choice(["the", "of", "and", f"w{k}"]) for k in range(120))
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, prose, "en", "s", 1), (9, prose + " token: abcdefgh", "en", "s", 1), (9, "other " + prose[::-1], "en", "s", 1), (9, "other " + prose[::-1], "en", "s", 1)]
    table = spark.createDataFrame([(*x, 1, 2, 3) for x in odd], DOCUMENTS + ", _drop int, key int, spans int")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: Counter((x["doc_id"], x["text"]) for x in df.collect())
    assert all(t and "w1" in t or "1w" in t for _, t in rows(stages["quality"](spark, table, "")))
    kept = rows(stages["near_dedup"](spark, table, ""))
    # Null and empty texts are copies; of a near copy without an id the one with an id stays; one id on two texts is two documents.
    assert kept == Counter({(1, None): 1, (9, odd[5][1]): 1, (9, odd[6][1]): 1})
    redacted = rows(stages["secrets"](spark, table, ""))
    assert redacted == Counter((i, t and t.replace("token: abcdefgh", "[SECRET]")) for i, t, *_ in odd)
    packed = stages["packing"](spark, table, "").collect()
    assert Counter(x["doc_id"] for x in packed) == Counter(i for i, *_ in odd) and len({(x["sequence_id"], x["offset"]) for x in packed}) == len(odd)
    for stage in stages.values():
        assert stage(spark, table.limit(0), "").collect() == []


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
