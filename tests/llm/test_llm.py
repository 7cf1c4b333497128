"""Each operator against a plain version, on a small fixture with every awkward case, and on the smallest table where that is quick."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import anchors, ctw, exact, factors, lines, mixing, pieces, quality, simhash, warc
from rasterloom.llm.components import connected_components

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, id string, block int, bucket int, kept boolean, rep long, n long"


def words_of(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice("the of and there their anthon ering ouch été über señor 日本 x1 a. B, c".split()) + rnd.choice(["", "", "s", "er", "ly"]) for _ in range(n)]


def fixture_rows():
    base = words_of(120, 1)
    passage = words_of(40, 2)
    long = " ".join(words_of(30_000, 3))
    said = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join(base[:60] + ["changed"] + base[61:]), 4: None, 5: "", 6: " \n\t ", 7: "one", 8: " ".join(words_of(80, 4) + passage), 9: " ".join(passage + words_of(70, 5)),
        10: long, 11: "a b c " * 200, 12: "line one is here now\nline one is here now\nAnother   LINE is here\n" * 3, 13: "é" * 300, 14: long[:5000], 15: "\0 odd \x85 chars   ▁▁ <s>  ", 16: "x" * 50, 17: "x" * 49, 18: "x" * 120,
        19: "Of The And", 20: "of the and", 21: "&&& ### *** " * 40,
    }
    rows = [(k, v) for k, v in said.items()] + [(None, "an orphan text"), (None, "an orphan text"), (2, said[2]), (7, "one")]
    return [(i, t, ["en", "de", None, "zz"][j % 4], ["src0", "src1", None][j % 3], "clash", 1, 2, None, 5, 6) for j, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def pairs():
    return [(r[0], r[1] or "") for r in fixture_rows()]


def multiset(rows):
    return collections.Counter(map(tuple, rows))


# ---------------------------------------------------------------- exact dedup


def test_trie_spills_by_subtree_and_keeps_all():
    rnd = random.Random(3)
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    trie = exact.PatriciaTrie(20_000)
    for i, k in enumerate(keys):
        trie.insert(k, i)
    assert trie.spills
    found = list(trie.terminals())
    want = collections.defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    assert len(found) == len(want) and {k: sorted(v) for k, v in found} == dict(want)


def test_trie_of_nested_texts_spills_without_recursion():
    for step in (1, 7):
        keys = [b"a" * i for i in range(0, 3000, step)] * 2
        trie = exact.PatriciaTrie(20_000)
        for i, k in enumerate(keys):
            trie.insert(k, i)
        assert trie.spills
        found = collections.Counter(k for k, v in trie.terminals() for _ in v)
        assert found == collections.Counter(keys)


def test_trie_sends_a_hot_text_in_parts(monkeypatch, spark):
    trie = exact.PatriciaTrie(10_000, 50)
    for i in range(1000):
        trie.insert(b"hot", i)
        trie.insert(b"x%d" % (i % 70), i)
        assert trie.bytes <= 3 * 10_000
    found = list(trie.terminals())
    assert sorted(i for k, v in found if k == b"hot" for i in v) == list(range(1000)) and max(len(v) for _, v in found) <= 50
    monkeypatch.setattr(exact, "MOST_COPIES", 3)
    rows = exact.exact_dedup(spark.createDataFrame([(i, "same") for i in range(20)], "doc_id long, text string"), keep="max").collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(19, 20)} and [r.doc_id for r in rows if r.kept] == [19]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(docs, keep):
    got = exact.exact_dedup(docs, keep=keep).collect()
    groups = collections.defaultdict(list)
    for i, t in pairs():
        groups[t].append(i)
    want = []
    for t, ids in groups.items():
        there = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(there) if there else None
        want += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert multiset((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == multiset(want)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stays = exact.exact_filter(docs, keep=keep)
    assert stays.columns == docs.columns and stays.count() == len(groups)


# ---------------------------------------------------------------- simhash


def plain_fingerprint(text, width):
    said = WHITE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(said[i : i + width]) for i in range(max(1, len(said) - width + 1))] if said else []
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def union_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash(docs):
    got = simhash.simhash_components(docs, width=4, k=4).collect()
    rows = pairs()
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    roots = union_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots)]
    assert multiset((r.doc_id, r.fingerprint, r.component_id) for r in got) == multiset(want)


def test_simhash_dedup_keeps_one_row_of_each_component(docs, spark):
    def roots_of(rows):
        fps = [plain_fingerprint(t or "", 4) for _, t in rows]
        return union_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])

    extra = [(None, " ".join(words_of(90, 71))), (None, " ".join(words_of(90, 72))), (None, " ".join(words_of(90, 72))), (50, " ".join(words_of(90, 73))), (50, " ".join(words_of(90, 74))), (51, " ".join(words_of(90, 74))), (None, None)]
    more = docs.union(spark.createDataFrame([(i, t, "en", lang, "s", 1, 2, None, 5, 6) for lang in ("b", "a") for i, t in extra], DDL))
    for df in (docs, more):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = {}
        for (i, _), r in zip(rows, roots_of(rows)):
            key = (i is None, i or 0)
            want[r] = min(key, want.get(r, key))
        got = simhash.simhash_dedup(df)
        assert got.columns == df.columns
        kept = got.collect()
        assert multiset((r.doc_id is None, r.doc_id or 0) for r in kept) == multiset(want.values())
        assert len(set(roots_of([(r.doc_id, r.text) for r in kept]))) == len(kept)
        assert sorted(map(str, kept)) == sorted(map(str, simhash.simhash_dedup(df.repartition(5)).collect()))


def test_trie_join_is_brute_force():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centres] + [rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    got = simhash.TrieJoin(np.array([0, len(fps)]), fps, 4).run()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = union_of(len(fps), list(zip(*np.nonzero(near))))
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(2)
    fps = sorted({int(x) for x in np.int64(5) ^ (np.int64(1) << rng.integers(0, 60, 300)) ^ (np.int64(1) << rng.integers(0, 60, 300))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = union_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 4])
    links = [(fps.index(r.fp), fps.index(r.other)) for r in simhash.linked(df, 4, shard_rows=20).collect()]
    got = union_of(len(fps), links)
    assert len(set(zip(got, whole))) == len(set(whole)) == len(set(got))


def test_simhash_keys_follow_the_number_of_fingerprints(spark, monkeypatch):
    assert [len(simhash.keys_for(4, n, 4000)) for n in (10**5, 10**9, 10**12)] == [5, 15, 35]
    assert all(simhash.copies_of(b, 4, n, 4000) <= 60 for b, n in ((5, 10**7), (6, 10**10), (7, 10**12)))
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20)
    fps = sorted({int(x ^ (np.int64(1) << a) ^ (np.int64(1) << b)) for x in base for a, b in rng.integers(0, 62, (8, 2))})
    whole = union_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 4])
    keys = simhash.keys_for
    for rows in (10**9, 10**12):  # as if there were so many
        monkeypatch.setattr(simhash, "keys_for", lambda k, _, shard, rows=rows: keys(k, rows, shard))
        links = [(fps.index(r.fp), fps.index(r.other)) for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()]
        got = union_of(len(fps), links)
        assert len(set(zip(got, whole))) == len(set(whole)) == len(set(got))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 and all(got[k] == 1000 for k in range(1000, 1100))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- pieces


def test_pieces_are_the_library(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.round_trip(docs, PIECES, whole=True).collect()
    want = []
    for i, t in pairs():
        ids = lib.encode(t) + [2]
        said = lib.decode(ids)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), tuple(ids), said))
    assert multiset((r[0], r[1], r[2], r[3], tuple(r[4]), r[5]) for r in got) == multiset(want)


def test_pieces_on_odd_strings():
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.MergePieces(PIECES)
    rnd = random.Random(5)
    for _ in range(2000):
        t = "".join(rnd.choice("   aabcdeehit\n\t日éß▁<>s01 😀") for _ in range(rnd.randint(0, 40)))
        assert mine.encode(t) == lib.encode(t) and mine.decode(mine.encode(t)) == lib.decode(lib.encode(t))
    for n in range(70):
        assert mine.encode(" " * n) == lib.encode(" " * n)


# ---------------------------------------------------------------- lines


def test_lines(docs):
    got = lines.line_components(docs).collect()
    rows = [(i, n, re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()) for i, t in pairs() for n, x in enumerate(t.split("\n"))]
    rows = [r for r in rows if r[2]]
    texts = sorted({r[2] for r in rows})
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a | b and len(a & b) >= 0.8 * len(a | b)]
    root = dict(zip(texts, union_of(len(texts), links)))
    assert links
    place = lambda r: (r[0] if r[0] is not None else math.inf, r[1])
    size, best = collections.Counter(root[r[2]] for r in rows), {}
    for r in rows:
        best[root[r[2]]] = min(place(r), best.get(root[r[2]], place(r)))
    want = multiset((r[0], r[1], size[root[r[2]]], place(r) == best[root[r[2]]]) for r in rows)
    assert multiset((r.doc_id, r.line_no, r.component_size, r.kept) for r in got) == want


def test_bands_find_similar_lines():
    """At least 0.95 of pairs with a similarity just above 0.8 share a band, in each class of sizes and over their borders."""
    rnd = random.Random(4)
    shingles = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    for low, high in ((lines.FEW, 20), (20, 60), (60, 90), (90, 240), (240, 330), (330, 1200)):
        pairs = []
        while len(pairs) < 150:
            one = two = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.randint(low + 4, high + 4)))
            for _ in range(200):
                at = rnd.randrange(len(two))
                two = two[:at] + "".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([0, 1, 4]))) + two[at + rnd.choice([0, 1, 4]) :]
                alike = len(shingles(one) & shingles(two)) / len(shingles(one) | shingles(two))
                if alike < 0.85:
                    break
            if 0.8 <= alike < 0.85:
                pairs += [(one, two)]
        bands, _, of = lines.bands_of([x for p in pairs for x in p], 5, 0.8)
        by = collections.defaultdict(set)
        for band, line in zip(bands.tolist(), of.tolist()):
            by[line].add(band)
        assert sum(bool(by[2 * i] & by[2 * i + 1]) for i in range(len(pairs))) >= 0.95 * len(pairs), (low, high)


def test_sketches_never_pass_over_a_similar_pair(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    said = base + [x[: len(x) * 9 // 10] + rnd.choice(["", "zz", "a longer end"]) for x in base]
    nodes = spark.createDataFrame(list(enumerate(said)), "node long, norm string")
    one = lines.sketched(nodes, 5)
    both = one.select(*(F.col(c).alias(f"a_{c}") for c in one.columns)).crossJoin(one.select(*(F.col(c).alias(f"b_{c}") for c in one.columns)))
    fits = {(r[0], r[1]) for r in both.where(lines.may_fit("a_", "b_", 0.8)).select("a_node", "b_node").collect()}
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in said]
    assert [r.m for r in one.orderBy("node").collect()] == [len(x) for x in sets]
    alike = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)}
    assert alike <= fits and len(fits) < len(said) ** 2 // 2


def test_hot_bands_are_chained_in_parts(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(120))
    said = [base[:50] + f"{i:05d}" + base[50:] for i in range(4000)] + ["tap it", "tap it!"] * 2
    nodes = spark.createDataFrame(list(enumerate(said)), "node long, norm string")
    hot = lines.hot_bands(nodes, 5, 0.8)
    assert hot and max(hot.values()) > 1
    by = collections.defaultdict(list)
    for r in lines.chains(nodes, 5, 0.8).collect():
        by[r.band].append(r)
    want = collections.defaultdict(set)
    for r in lines.band_rows(nodes, 5).collect():
        want[r.band].add(r.node)
    assert {b: sorted(x) for b, x in want.items() if len(x) > 1} == {b: sorted(r.node for r in x) for b, x in by.items() if len(x) > 1} and max(map(len, by.values())) >= 3000
    for found in by.values():  # each bucket is one chain
        place = {r.node: i for i, r in enumerate(found)}
        assert len(set(union_of(len(found), [(place[r.node], place[r.prev]) for r in found if r.prev is not None]))) == 1
        if any(r.kind == 1 for r in found):
            assert {r.whole for r in found} == {min(r.node for r in found if r.kind == 1)}


def test_similarity_of_pairs_is_exact():
    rnd = random.Random(11)
    said = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    said += [x[: len(x) * 9 // 10] + rnd.choice(["", "zz"]) for x in said]
    pairs = [(i, j) for i in range(len(said)) for j in range(i)]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in said]
    assert lines.alike(pairs, said, 5, 0.8).tolist() == [len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in pairs]


def line_groups(spark, said, **options):
    """The component of each line, one document a line."""
    got = lines.line_components(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), **options).collect()
    return [{r.doc_id: r.component for r in got}[i] for i in range(len(said))]


def test_lines_of_unlike_word_counts_share_bands(spark):
    long = "donaudampfschifffahrtsgesellschaft kraftfahrzeughaftpflichtversicherung rechtsschutzversicherungsgesellschaft arbeiterunfallversicherungsgesetz nahrungsmittelunvertraglichkeit betriebskostenabrechnung geschwindigkeitsbegrenzung bezirksschornsteinfegermeister"
    rnd = random.Random(8)
    said = [long, long.replace("kraft", "1 2 3 4 5 6 7 kraft")]
    for n in range(56, 92, 4):  # across MANY and MANY / 0.8, one end longer by up to a fifth
        base = "".join(rnd.choice("abcdefghij") for _ in range(n))
        said += [base, base + " " + " ".join("klmnopqrst"[: n // 16])]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in said]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    got = line_groups(spark, said)
    assert all(a == b for a, b in zip(got[::2], got[1::2])) and len(set(got)) == len(said) // 2


def test_lines_that_repeat_a_phrase_match_at_any_length(spark):
    phrase = "buy two of these fine lamps today and get the third for free "
    one, two, other = line_groups(spark, [phrase * 2, phrase * 12, "nothing that either of those two lines says is said in here"])
    assert one == two != other


def test_short_lines_match_by_their_sets(spark):
    rnd = random.Random(9)
    said = ["click here", "click here!", "tap", "taps", "x" * 50, "x" * 120, "read more", "read mores", "read more..", "log in", "log in now"]
    said += ["".join(rnd.choice("ab") for _ in range(rnd.randint(3, 15))) for _ in range(150)]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in said]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if said[i] == said[j] or a | b and len(a & b) >= 0.8 * len(a | b) and min(len(a), len(b)) < lines.FEW]
    want = union_of(len(said), links)
    some = [i for i, x in enumerate(sets) if len(x) < lines.FEW]
    got = line_groups(spark, said)
    assert got[0] == got[1] and got[2] != got[3] and got[4] == got[5]
    assert all(got[a] == got[b] for a, b in links)
    more = union_of(len(said), [*links, *((i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a | b and len(a & b) >= 0.8 * len(a | b))])
    assert all(more[i] == more[j] for i in some for j in some if got[i] == got[j]) and len(set(want)) < len(said)
    with pytest.raises(ValueError):
        lines.line_components(spark.createDataFrame([(1, "a")], "doc_id long, text string"), threshold=0.7)


# ---------------------------------------------------------------- quality


def test_quality_counts(docs):
    got = quality.quality_rules(docs, PIECES, RANKS).collect()
    want = []
    for i, t in pairs():
        said = WHITE.findall(t)
        wins = collections.Counter(tuple(said[j : j + 3]) for j in range(len(said) - 2))
        hit = {j + d for j in range(len(said) - 2) if wins[tuple(said[j : j + 3])] > 1 for d in range(3)}
        full = [x for x in t.split("\n") if WHITE.search(x)]
        want.append((i, len(said), sum(map(len, said)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(hit), len(said) < 50 or 100 * len(hit) > 50 * len(said)))
    assert multiset(tuple(r)[:7] for r in got) == multiset(want)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.quality_filter(docs, PIECES, RANKS)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_fertility_tells_junk(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = {r.doc_id: r for r in quality.quality_rules(rows.select("doc_id", "text", "lang"), PIECES, RANKS).collect()}
    labelled = {r.doc_id: r.quality for r in rows.select("doc_id", "quality").collect()}
    clean = [got[i] for i, q in labelled.items() if q == 1 and not got[i].base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    by_bands = [i for i, q in labelled.items() if not got[i].base_failed and not got[i].kept]
    assert by_bands and all(labelled[i] == 0 for i in by_bands)


def test_fertility_is_that_of_the_libraries(docs):
    import base64

    import tiktoken

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(RANKS, "rb") as f:
        ranks = tiktoken.Encoding("plain", pat_str=quality.RANK_PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = []
    for (i, t), row in zip(pairs(), fixture_rows()):
        said = WHITE.findall(t)
        ids = [x for w in said for x in lib.encode(w)]
        ranked = sum(len(ranks.encode_ordinary(" " + w)) for w in said)
        share = sum(lib.is_byte(x) for x in ids) / len(ids) if ids else 0.0
        spread = -sum(c / len(ids) * math.log2(c / len(ids)) for c in collections.Counter(ids).values())
        per = 2 * (sum(map(len, said)) + len(said)) / (len(ids) + ranked) if ids else 0.0
        wins = collections.Counter(zip(said, said[1:], said[2:]))
        hit = {j + d for j, x in enumerate(zip(said, said[1:], said[2:])) if wins[x] > 1 for d in range(3)}
        kept = len(said) >= 50 and 100 * len(hit) <= 50 * len(said)
        if kept and len(ids) >= 50:
            band = quality.BANDS.get(row[2]) or quality.SCRIPT_BANDS[quality.script_of(t)]
            kept = band.least_chars_per_token <= per <= band.most_chars_per_token and share <= band.most_byte_share and spread >= band.least_entropy
        want.append((-1 if i is None else i, len(ids), round(per, 6), round(share, 6), abs(round(spread, 6)), kept))
    got = quality.quality_rules(docs, PIECES, RANKS).collect()
    assert multiset((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.chars_per_token, 6), round(r.byte_share, 6), abs(round(r.token_entropy, 6)), r.kept) for r in got) == multiset(want)


def test_words_of_many_documents_are_looked_up_once(monkeypatch):
    model = quality.Fertility(PIECES, RANKS)
    said = [t.encode() for _, t in pairs()] + [" ".join(w for w in "a b ab c d é x1".split() for _ in range(9)).encode()] * 40 + [b"", b"a b c", b"\xff a \xff a b \xff a"]
    alone = [quality.measured([t], ["en"], model, quality.BANDS, 50)[0] for t in said]
    seen = []
    monkeypatch.setattr(model.words, "get", lambda w, get=model.words.get: seen.append(w) or get(w))
    together = quality.measured(said, ["en"] * len(said), model, quality.BANDS, 50)
    assert len(seen) == len(set(seen)) > 50
    for a, b in zip(alone, together, strict=True):
        assert a[:9] == b[:9] and a[9] == pytest.approx(b[9], abs=1e-9) and a[10] == b[10]


def test_scripts():
    assert [quality.script_of(x) for x in ("hello été", "привет мир", "日本語です", "12 !", "שלום")] == ["latin", "cyrillic", "cjk", "other", "hebrew"]


# ---------------------------------------------------------------- mixing


def test_raking_meets_the_marginals():
    rnd = random.Random(1)
    cells = [(s, l, t, rnd.randint(500, 5000)) for s in "ab" for l in ("en", "de") for t in ("x", "y", "z")]
    aim = mixing.Targets({"a": 0.4, "b": 0.6}, {"en": 0.55, "de": 0.45}, {"x": 0.3, "y": 0.3, "z": 0.4})
    p = mixing.raked(cells, aim, 0.4)
    mass = sum(c[3] for c in cells) * 0.4
    assert (p <= 1).all() and (p > 0).all()
    for at, shares in ((0, aim.source), (1, aim.language), (2, aim.topic)):
        for name, share in shares.items():
            assert sum(c[3] * x for c, x in zip(cells, p) if c[at] == name) == pytest.approx(share * mass, rel=1e-6)


def test_shares_that_cannot_be_met_are_told():
    cells = [("a", "en", "x", 100), ("b", "en", "x", 900)]
    p = mixing.raked(cells, mixing.Targets({"a": 0.5, "b": 0.5}), 0.5)
    assert {(m, k): round(r, 3) for m, k, _, r in mixing.shortfall(cells, p, mixing.Targets({"a": 0.5, "b": 0.5}), 0.5)}["source", "a"] == 0.2
    assert mixing.shortfall(cells, mixing.raked(cells, mixing.Targets({"a": 0.1, "b": 0.9}), 0.5), mixing.Targets({"a": 0.1, "b": 0.9}), 0.5) == []


def test_mixing_rows_are_those_of_a_plain_version(docs):
    """Counts, keys, probabilities by plain proportional fitting and the draw by the hash of the id, row by row."""
    aim, budget = mixing.Targets({"src0": 0.3, "src1": 0.3}, {"en": 0.3, "de": 0.2}, {"note": 0.01}), 0.01
    rows = []
    for i, t, lang, source, *_ in fixture_rows():
        n = len(WHITE.findall(t or ""))
        rows.append((i, n, source if source in aim.source else "other", lang if lang in aim.language else "other", "note" if n < 100 else "other"))
    cells = collections.Counter()
    for _, n, *key in rows:
        cells[tuple(key)] += n
    total, p = sum(cells.values()), dict.fromkeys(cells, budget)
    for _ in range(2000):
        for at, shares in enumerate((aim.source, aim.language, aim.topic)):
            there = {k[at] for k in cells if cells[k]}
            shares = {k: x for k, x in {**shares, "other": 1 - sum(shares.values())}.items() if any(c[at] == k and cells[c] for c in cells)}
            for name in there:
                have = sum(cells[k] * p[k] for k in cells if k[at] == name)
                for k in cells:
                    if k[at] == name and have:
                        p[k] *= shares[name] / sum(shares.values()) * budget * total / have
    assert max(p.values()) < 1  # so no cell is cut off, and plain fitting is enough
    draw = lambda i: (xxhash.xxh64_intdigest((42).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) & (1 << 53) - 1) / 2**53
    got = {(r.doc_id, r.n_tokens, r.source_key, r.language_key, r.topic_key): r for r in mixing.mixing_weights(docs, aim, budget).collect()}
    assert set(got) == {(i, n, *key) for i, n, *key in rows}
    for i, n, *key in rows:
        r = got[i, n, *key]
        if n:
            assert r.probability == pytest.approx(p[tuple(key)], rel=1e-5) and r.weight == pytest.approx(r.probability / budget)
        if i is not None:
            assert r.sampled == (draw(i) < r.probability)


def test_clashing_names_of_columns(spark):
    """Tables that have the operators' own names already: nothing is lost, nothing ambiguous, and values stay."""
    names = "own_id own_sha own_of own_one own_stays own_mark own_copies own_row own_s own_p _id _one _stays weight probability n_tokens sampled keep_id kept component text_sha256 node band norm".split()
    said = [(i, t, "en", "src0") for i, t in [(1, "a b c"), (2, "a b c"), (None, "x y"), (3, None), (3, None)]]
    df = spark.createDataFrame([(*r, *[f"{n}{j}" for n in names]) for j, r in enumerate(said)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for out in (exact.exact_filter(df), simhash.simhash_dedup(df), mixing.mixing_sample(df, mixing.Targets(), 1.0)):
        assert out.columns == df.columns
        for r in out.collect():
            assert len({r[n].removeprefix(n) for n in names}) == 1
    found = mixing.mixing_weights(df, mixing.Targets(), 1.0)
    assert len(set(found.columns)) == len(found.columns) and {r.weight_of_row for r in found.collect()} == {f"weight{j}" for j in range(5)}
    for out, n in ((exact.exact_dedup(df), 5), (simhash.simhash_components(df), 5), (lines.line_components(df), 3), (quality.quality_rules(df, PIECES, RANKS), 5), (pieces.round_trip(df, PIECES), 5), (anchors.repeated_passages(df), 5), (factors.earlier_copies(df), 5)):
        assert out.count() == n
    assert exact.exact_filter(df).count() == 3 and simhash.simhash_dedup(df).count() == 3


def test_mixing(docs, spark):
    aim = mixing.Targets({"src0": 0.5}, {"en": 0.5})
    got = mixing.mixing_weights(docs, aim, 0.5).collect()
    assert len(got) == docs.count() and all(0 <= r.probability <= 1 for r in got)
    assert [(r.doc_id, r.sampled) for r in sorted(got, key=str)] == [(r.doc_id, r.sampled) for r in sorted(mixing.mixing_weights(docs.repartition(7), aim, 0.5).collect(), key=str)]
    assert mixing.mixing_sample(docs, aim, 0.5).columns == docs.columns
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"), F.lit("en").alias("lang"))
    share = mixing.mixing_sample(big, mixing.Targets({"x": 0.5}), 0.4).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in share} == {"x": pytest.approx(4000, rel=0.05), "y": pytest.approx(4000, rel=0.05)}
    with pytest.raises(ValueError):
        mixing.Targets({"a": 0.7, "b": 0.7})


# ---------------------------------------------------------------- archives


def test_archives(spark, tmp_path):
    page = "<p>" + "x" * 1200
    said = [(1, "http://A.example.org/p?q=1", page), (2, "https://b.example.org/", page), (3, None, None), (4, "http://c.example/\r\nbad", "short"), (5, "http://c.example/", "short"), (None, "http://a.example.org/z", page), (6, "http://a.example.org/p", "é\r\n\r\nWARC/1.1\r\n" * 100), (7, "u", "")]
    pages = spark.createDataFrame([(*r, 9, "s") for r in said], "page_id long, url string, html string, id long, digest string")
    folder = f"file://{tmp_path}/w"
    got = warc.archived(pages, folder).collect()
    want = []
    for i, _, h in said:
        b = (h or "").encode()
        revisit = h == page and i != 2
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert multiset((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == multiset(want)
    order = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range, r.position))]
    assert order == sorted(order)
    back = {r.page_id: r.payload for r in warc.captures(spark, folder, payloads=True).collect()}
    assert back[6] == said[6][2].encode() and back[1] is None and back[3] == b""


def test_loser_tree():
    rnd = random.Random(2)
    for k in range(0, 9):
        runs = [sorted((rnd.randint(0, 50), j) for j in range(rnd.randint(0, 20))) for _ in range(k)]
        got = [key for key, _ in warc.LoserTree([[(x, x) for x in r] for r in runs])]
        assert got == sorted(x for r in runs for x in r)


def test_external_merge_of_many_runs(monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    rnd = random.Random(3)
    schema = warc.pa.schema([(c, t) for c, t, _ in warc.CAPTURE])
    row = lambda: (rnd.choice("abc"), str(rnd.randint(0, 9)), rnd.choice([None, rnd.randint(0, 99)]), "response", "", 0, None, "f", rnd.randint(0, 10**6), 1)
    runs = [sorted((row() for _ in range(rnd.randint(1, 40))), key=warc._key) for _ in range(25)]
    merging = warc.ExternalMerge(schema)
    for run in runs:
        merging.begin()
        for batch in warc.batches_of(run, schema, 7):
            merging.add(batch)
    assert len(merging.levels) >= 3 and list(merging.rows()) == sorted((r for run in runs for r in run), key=warc._key)


def test_large_pages_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", "x" * (100_000 + i if i % 2 else 10 + i)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    got = warc.archived(pages, f"file://{tmp_path}/archive").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, 100_000 + i if i % 2 else 10 + i) for i in range(20)]
    assert max(f.stat().st_size for f in (tmp_path / "archive").glob("part-*")) < 300_000


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"))
    assert warc.url_key("https://User@WWW.Example.org:80/A?b") == "org,example,www)/A?b"


def test_an_idle_worker_lets_its_model_go(monkeypatch):
    from rasterloom.llm import common

    monkeypatch.setattr(common, "IDLE", 0.3)
    made = []

    def run(batches):
        common.only_model(("test",), lambda: made.append(1) or {})
        yield from batches

    task = common.rested(run)
    assert list(task([1, 2])) == [1, 2] and list(task([3])) == [3] and made == [1]  # soon again: the same model
    for _ in range(100):
        if not common._model:
            break
        time.sleep(0.1)
    assert not common._model and list(task([4])) == [4] and made == [1, 1]


def test_pieces_go_out_by_characters(spark, monkeypatch):
    rows = [(i, f"some words {i} " * 40) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = pieces.round_trip(df, PIECES, whole=True).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r.doc_id: r.ids for r in got} == {i: model.encode(t or "", add_eos=True) for i, t in rows}
    sizes, run = [], {}
    monkeypatch.setattr(pieces, "CHARS", 1000)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, ddl: run.setdefault("f", f))
    pieces.round_trip(df, PIECES, whole=True)
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t or "" for _, t in rows]})
    for out in run["f"](iter([batch])):
        sizes.append(len(out))
    assert sum(sizes) == len(rows) and max(sizes) < 10


# ---------------------------------------------------------------- context trees


def plain_ctw(rows, depth=2):
    nodes = collections.defaultdict(lambda: [0, 0])
    train = [t for i, t in rows if not ctw.held_out(i)]
    walk = lambda b: [(b[p - d : p], b[p]) for p in range(2, len(b)) for d in range(depth + 1)]
    for t in train:
        for ctx, byte in walk(b"\xff\xff" + t.encode() + b"\xff"):
            node = 1
            for k in range(7, -1, -1):
                nodes[ctx, node][byte >> k & 1] += 1
                node = node * 2 + (byte >> k & 1)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    down, w, own_share = collections.defaultdict(list), {}, {}
    for ctx, node in nodes:
        if ctx:
            down[ctx[1:], node].append((ctx, node))
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        own = kt(*nodes[key])
        if len(key[0]) == depth:
            w[key], own_share[key] = own, 1.0
        else:
            w[key] = math.log(0.5) + np.logaddexp(own, sum(w[k] for k in down[key]))
            own_share[key] = math.exp(math.log(0.5) + own - w[key])

    def one(ctx, node, d):
        key = (ctx[len(ctx) - d :], node)
        if key not in nodes:
            return 0.5
        a, b = nodes[key]
        p = (b + 0.5) / (a + b + 1)
        return p if d == depth else own_share[key] * p + (1 - own_share[key]) * one(ctx, node, d + 1)

    out = []
    for _, t in rows:
        b, s = b"\xff\xff" + t.encode() + b"\xff", 0.0
        for p in range(2, len(b)):
            node = 1
            for k in range(7, -1, -1):
                q = one(b[p - 2 : p], node, 0)
                s += math.log10(q if b[p] >> k & 1 else 1 - q)
                node = node * 2 + (b[p] >> k & 1)
        out.append(s)
    return out


def test_context_tree(docs):
    rows = [(i, t if len(t) < 4000 else t[:600]) for i, t in pairs()]
    short = docs.withColumn("text", F.when(F.length("text") < 4000, F.col("text")).otherwise(F.substring("text", 1, 600)))
    got = ctw.context_tree_scores(short, depth=2).collect()
    low = lambda t: WHITE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + [None]
    counts = collections.Counter(w for i, t in rows if not ctw.held_out(i) for w in low(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((-1 if i is None else i), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(low(t)), sum(counts[w] > 0 for w in low(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in low(t)), s) for (i, t), s in zip(rows, plain_ctw(rows)))
    mine = sorted(((-1 if r[0] is None else r[0]), *tuple(r)[1:7]) for r in got)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def deep_ctw(rows, depth):
    """Scores by a tree of dictionaries."""
    nodes, down = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    edge = b"\xff" * depth

    def steps(t):
        b = edge + t.encode() + b"\xff"
        for p in range(depth, len(b)):
            for k in range(8):
                yield b[p - depth : p], 1 << k | b[p] >> (8 - k), b[p] >> (7 - k) & 1

    for i, t in rows:
        for ctx, node, bit in [] if ctw.held_out(i) else steps(t):
            for d in range(depth + 1):
                nodes[ctx[depth - d :], node][bit] += 1
                if d:
                    down[ctx[depth - d + 1 :], node].add((ctx[depth - d :], node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    w, share = {}, {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        own = kt(*nodes[key])
        w[key] = own if len(key[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(w[k] for k in down[key]))
        share[key] = 1.0 if len(key[0]) == depth else math.exp(math.log(0.5) + own - w[key])

    def one(ctx, node):
        reach, sure = 1.0, 0.0
        for d in range(depth + 1):
            key = (ctx[depth - d :], node)
            if key not in nodes:
                return sure + reach * 0.5
            a, b = nodes[key]
            sure += reach * share[key] * (b + 0.5) / (a + b + 1)
            reach *= 1 - share[key]
        return sure

    return [sum(math.log10(q if bit else 1 - q) for q, bit in ((one(ctx, node), bit) for ctx, node, bit in steps(t))) for _, t in rows]


@pytest.mark.parametrize("depth", [3, 8])
def test_deep_context_tree(docs, depth):
    rows = [(i, t[:600]) for i, t in pairs()]
    short = docs.withColumn("text", F.substring("text", 1, 600))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in ctw.context_tree_scores(short, depth=depth).collect())
    for a, b in zip(got, sorted((-1 if i is None else i, s) for (i, _), s in zip(rows, deep_ctw(rows, depth))), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5)
    base = {r.doc_id: tuple(r)[:6] for r in ctw.context_tree_scores(short, depth=2).collect()}
    assert all(base[r.doc_id] == pytest.approx(tuple(r)[:6]) for r in ctw.context_tree_scores(short, depth=depth).collect() if r.doc_id is not None)


def test_query_8_looks_back_eight_bytes(spark, monkeypatch):
    from rasterloom.llm import queries

    said = ["q" + "".join(x) + "!" for x in (random.Random(k).choices("ab", k=7) for k in range(3)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(x[:8] + ("cd"[x[1] == "a"]) for x in said)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {r.doc_id: r.score for r in queries.op8_context_tree(spark, "").collect()}
    two = {r.doc_id: r.score for r in ctw.context_tree_scores(df, depth=2).collect()}
    assert sum(got.values()) > sum(two.values())
    assert ctw.context_tree_scores(df.limit(0), depth=8).count() == 0


def test_a_crowded_range_goes_in_parts(monkeypatch):
    from rasterloom.llm import deep

    low = [0, ord("n") << 56]
    said = []
    for block in range(4):
        chosen = random.Random(block)
        text = [" ".join(chosen.choices(["anna", "bob", "nine", "nana", "banana", "ox"], k=60)).encode() for _ in range(20)]
        contexts, byte, count = ctw._entries([(list(range(20)), text)], 8, lambda i: i % 4 > 0)
        ends = np.append(np.searchsorted(contexts, np.array(low, np.uint64)), len(contexts))
        said.append((block, (deep.pack_keys(np.zeros(0, np.uint64)), np.zeros(0, np.int64), {j: deep.pack(*(x[ends[j] : ends[j + 1]] for x in (contexts, byte, count))) for j in range(2)}, np.zeros(0, np.uint64))))
    told, most = [], []
    for limit in (1 << 20, 200):
        monkeypatch.setattr(ctw, "MOST", limit)
        most.append(max(len(back) for _, back, _ in ctw._ranges(said, 8, low)))
        ((_, _, (_, _, opened)),) = ctw._climb(8, low)(said)
        spine = type("Spine", (), {"value": deep.joined(opened, 8)})
        told.append([deep.unpack_logs(data[1]) for _, _, data in ctw._tell(8, low, spine)(said)])
    assert most[0] > 1000 and most[1] < 500
    for a, b in zip(*told, strict=True):
        assert len(a) == len(b) and a == pytest.approx(b, rel=1e-5, abs=1e-7)


def test_places_are_those_of_a_plain_version():
    from rasterloom.llm import deep

    said = [b"", b"ab", b"banana \xff\xff\0band", b"abab" * 50, b"n"]
    for depth in (1, 3, 8):
        want = sorted((bytes([255]) * depth + t)[p : p + depth][::-1] + (t + b"\xff")[p : p + 1] for t in said for p in range(len(t) + 1))
        for most in (None, 1, 20):
            found, seen = [], []
            places = deep.Places(said, depth)
            for v, at, keys in places.by_last(most):
                assert len(set(at.tolist())) == len(at) and (places.buf[at - 1] == v).all()
                contexts, byte = deep.split(v, np.sort(keys))
                found += [int(c).to_bytes(8, "big")[:depth] + bytes([b]) for c, b in zip(contexts, byte)]
                seen += at.tolist()
            assert found == want and len(set(seen)) == len(seen) == sum(len(t) + 1 for t in said)


def test_packed_blocks_hold_every_row_once_and_leave_a_shuffle_small(spark):
    from rasterloom.llm import blocks

    rows = fixture_rows()
    df = spark.createDataFrame(rows, DDL).repartition(3)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.packed(df, "doc_id", "text", n).toArrow()
    assert len(set(found["block"].to_pylist())) <= max(1, n // 2)
    back = [(i, t.decode()) for ids, said in blocks._documents(found) for i, t in zip(ids, said)]
    assert sorted(back, key=str) == sorted(pairs(), key=str)
    assert sum(len(x) for x in found["data"].to_pylist()) < sum(len(t.encode()) for _, t in pairs()) // 2


def test_ranges_are_packed_as_the_contexts_come():
    from rasterloom.llm import deep

    held = [([1, 2, 3], [b"anna banana bandana", b"", b"zz top zoo"])]
    contexts, byte, count = ctw._entries(held, 8, lambda i: i < 3)
    for step in (1, 3, 50):
        low = [0, *np.unique(contexts)[1::step].tolist(), (1 << 64) - 1]
        found = ctw._packed(held, 8, lambda i: i < 3, low)
        of = np.searchsorted(np.array(low, np.uint64), contexts, "right") - 1
        assert sorted(found) == np.unique(of).tolist()
        for j, data in found.items():
            assert all((x == y[of == j]).all() for x, y in zip(deep.unpack(data), (contexts, byte, count)))


def test_keys_and_counts_come_back_from_messages():
    from rasterloom.llm import deep

    for keys in ([], [0], [3, 5, 1 << 40, (1 << 64) - 1]):
        assert deep.unpack_keys(deep.pack_keys(np.array(keys, np.uint64))).tolist() == keys
    for counts in ([], [0, 255], [256], [1 << 33, 1]):
        assert deep.narrow(np.array(counts, np.int64)).tolist() == counts


def test_ranges_of_contexts_are_even_however_many(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}" for i in range(4000)]
    rows = [(i, " ".join(words)) for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id").select("doc_id", "text")
    low = np.array(ctw._splitters(spark.createDataFrame(df.rdd, df.schema), "doc_id", "text", 8, 400), np.uint64)
    contexts, _, _ = ctw._entries([([i], [t.encode()]) for i, t in rows], 8, lambda i: True)
    sizes = np.diff(np.append(np.searchsorted(contexts, low), len(contexts)))
    assert len(low) > 500 and sizes.max() < 12 * len(contexts) / 800


# ---------------------------------------------------------------- substrings


def test_anchors(docs):
    got = anchors.repeated_passages(docs, whole=True).collect()
    rows, w = pairs(), 35
    said = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for _, t in rows]
    seen = collections.Counter(b" ".join(x[p : p + w]) for x in said for p in range(len(x) - w + 1))
    want = []
    for (i, _), x in zip(rows, said):
        gone = {q for p in range(len(x) - w + 1) if seen[b" ".join(x[p : p + w])] > 1 for q in range(p, p + w)}
        kept = b" ".join(v for q, v in enumerate(x) if q not in gone)
        want.append((i, len(x), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert multiset((r[0], r[1], r[2], r[3], r.kept) for r in got) == multiset(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_with_equal_polynomials_stay_apart(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(34))
    got = anchors.repeated_passages(spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]
    out = next(i for i in range(99) if ctw.held_out(i))
    known = next(i for i in range(99) if not ctw.held_out(i))
    got = {r.doc_id: r.n_known for r in ctw.context_tree_scores(spark.createDataFrame([(out, two), (known, one)], "doc_id long, text string"), depth=2).collect()}
    assert got == {out: 1, known: 2}


@pytest.mark.parametrize("k", [8, 24, 50])
def test_factors(docs, k):
    got = factors.earlier_copies(docs, k=k, whole=True).collect()
    rows, w = [((factors.LAST if i is None else i), i, t.encode()) for i, t in pairs()], 50
    first = {}
    for rank, _, b in sorted(rows, key=lambda r: r[0]):
        for p in range(len(b) - w + 1):
            first.setdefault(b[p : p + w], rank)
    want = []
    for rank, i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - w + 1):
            if first[b[p : p + w]] < rank:
                gone[p : p + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    assert multiset((r[0], r[1], r[2], r[3], r[4], bytes(r.kept)) for r in got) == multiset(want)


def test_previous_factors_are_brute_force():
    rng = np.random.default_rng(4)
    for letters, size, width in ((2, 300, 20), (3, 300, 9), (20, 200, 50), (1, 120, 30)):
        text = rng.integers(0, letters, size).astype(np.uint8)
        padded = np.concatenate([text, np.zeros(width, np.uint8)])
        where = np.sort(rng.choice(size - width, (size - width) * 3 // 4, replace=False))
        docs = where // 37 % 5
        names = [padded[i : i + width].tobytes() for i in where]
        common = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
        order, got = factors.suffix_order(padded, where, docs, width)
        assert [(names[i], docs[i]) for i in order] == sorted(zip(names, docs)) and got.tolist() == [0, *(common(names[a], names[b]) for a, b in zip(order, order[1:]))]
        want = [max((common(names[j], names[i]) for j in range(len(where)) if docs[j] < docs[i]), default=0) for i in range(len(where))]
        assert factors.previous_factors(padded, where, docs, width).tolist() == want


# ---------------------------------------------------------------- all of them


def test_empty_tables(spark, empty):
    for df in (
        exact.exact_dedup(empty), exact.exact_filter(empty), simhash.simhash_components(empty), simhash.simhash_dedup(empty), pieces.round_trip(empty, PIECES), lines.line_components(empty),
        quality.quality_rules(empty, PIECES, RANKS), quality.quality_filter(empty, PIECES, RANKS), mixing.mixing_weights(empty, mixing.Targets(), 0.5), ctw.context_tree_scores(empty),
        anchors.repeated_passages(empty), factors.earlier_copies(empty), warc.archived(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_pipeline_stages_take_any_table(spark, docs, empty):
    """Nulls, empty and long texts, repeated rows and clashing names through every stage; an empty table too."""
    import corpus_pipeline

    for df in (docs, empty):
        at = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, "")
            assert at.columns == df.columns
            known = multiset(map(str, df.collect()))
            rows = multiset(map(str, at.collect()))
            assert all(known[r] >= n for r, n in rows.items())  # rows stay as they are, or go
            assert not rows or corpus_pipeline.STAGES[0][1](spark, df, "").count() > 0
        assert corpus_pipeline.STAGES[-1][1](spark, at, "").count() == at.count()
    for _, stage in corpus_pipeline.STAGES[1:]:  # each on the whole fixture
        assert stage(spark, docs, "").count() <= docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in at.collect()}
        at = stage(spark, at, sf).cache()
        assert at.columns == docs.columns
        now = {r.doc_id for r in at.collect()}
        assert now < set(before) or now == set(before)
        if name == "exact dedup":
            last = {}
            for i, r in before.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert now == set(last.values())
        if name == "SimHash near-dedup":
            ids = sorted(before)
            fps = [plain_fingerprint(before[i].text, 4) for i in ids]
            roots = union_of(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
            first = {}
            for i, r in zip(ids, roots):
                first.setdefault(r, i)
            assert now == set(first.values())
        kept.append(len(now))
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == kept[-1] and {r.doc_id for r in out} == now
