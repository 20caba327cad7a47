"""Each operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomstead.llm import graph, induced, language_id, media, mixing, near_duplicates, pieces, queries, repeats, sharding, tiff, token_counts, token_store, topk
from loomstead.llm.common import documents

SF = "/root/testdata/sf0.001"
PASSAGE = "the quick brown fox jumps over the lazy dog while the band plays on and on"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, slot int, copy int, score string, k int, t int, c int"
TEXTS = [(0, f"alpha {PASSAGE} omega"), (1, f"beta {PASSAGE} gamma"), (2, None), (3, ""), (4, "short"), (5, f"alpha {PASSAGE} omega"), (6, "é" * 400), (7, "é" * 300), (8, " \n\t "), (9, "a▁b  c 漢字 😀 "), (9, "a▁b  c 漢字 😀 "), (None, f"beta {PASSAGE} gamma"), (10, "word " * 30000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i == 3 else f"s{(i or 0) % 2}", 0, 1, "x", 1, 1, "y", 1, 1, 1) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    found = token_store.MinimalPerfectHash.build(keys)
    assert sorted(found.slots(keys)) == list(range(len(keys)))


def test_token_store_is_whole(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.WORD_BPE)
    plain = Tokenizer.from_file(path)
    stored = token_store.write_token_shards(odd, path, shard_ids=50)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in collect(token_store.with_starts(token_store.read_token_shards(spark, stored)))), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (-1 if x[0] is None else x[0])):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((-1 if i is None else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    found = collect(token_store.lookup(spark, stored, odd.select("doc_id").union(spark.range(500, 510).toDF("doc_id"))))
    assert sorted(r["key"] for r in found) == sorted(i for i, _ in TEXTS if i is not None)
    assert next(r["ids"] for r in found if r["key"] == 4) == plain.encode("short", add_special_tokens=False).ids + [1]


def test_special_tokens_in_texts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.WORD_BPE)
    texts = ["x <|endoftext|> y", "a<|endoftext|>b <|x|> C", "<|EndOfText|> <|STARTOFTEXT|>", "<|startoftext|><|endoftext|>", "X<|endoftext|", "é <|startoftext|>\nÉ 漢 <|endoftext|>", "<|endof text|>", "< |endoftext|>", "<<|endoftext|>>"]
    enc, plain = token_store.ChunkEncoder(path), Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(r, enc.kind).tolist() for r in enc.encode(texts)] == want
    assert [np.frombuffer(enc.encode([t])[0], enc.kind).tolist() for t in texts] == want
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    counted = {r["doc_id"]: r["n_tokens"] for r in collect(token_counts.count_tokens(docs, path, "v1"))}
    assert counted == {i: len(w) for i, w in enumerate(want)}


def brute_removed(rows, width=50):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_repeats_are_removed_exactly(odd, none):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in collect(repeats.remove_repeats(odd))]
    assert sorted(got, key=repr) == sorted(brute_removed(TEXTS), key=repr)
    assert collect(repeats.remove_repeats(none)) == []
    cut = {r["doc_id"]: r["text"] for r in collect(repeats.cleaned(odd)) if r["doc_id"] is not None}
    assert cut[0] == TEXTS[0][1] and cut[5] == "" and cut[2] is None and PASSAGE[:40] not in cut[1]


def test_repeats_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in collect(queries.op2_suffix_dedup(spark, SF))}
    assert got == {i: (n, hashlib.sha256(k).hexdigest()) for i, _, n, _, k in brute_removed(rows)}


def test_a_hot_anchor_is_not_sorted_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    near = [word(80) for _ in range(7)]
    rows = [(k, f"{near[k % 7] if k % 3 else word(80)}{PASSAGE}{near[k % 5] if k % 4 else word(80)}") for k in range(400)]
    most = 1000
    monkeypatch.setattr(repeats, "SHARD_BYTES", most)
    sort = repeats._settle

    def bounded(texts, rows, width, limit):
        if sum(len(c[0]) for c in texts) > 5 * most:
            raise ValueError("too many bytes in one sorting task")
        return sort(texts, rows, width, limit)

    monkeypatch.setattr(repeats, "_settle", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in collect(repeats.remove_repeats(docs))]
    assert sorted(got) == sorted(brute_removed(rows))


@pytest.mark.parametrize("letters", [1, 2, 5, 200, 3000])
@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_suffix_order_and_common_prefixes(letters, limit):
    """Order and carried prefixes by brute force, with queues that spill all the time and recursion to the end."""
    rng = np.random.default_rng(letters)
    for n in (1, 2, 7, 50, 400):
        for periodic in (False, True):
            a = rng.integers(1, letters + 1, n)
            a = np.append(np.tile(a[: max(1, n // 5)], 6)[:n] if periodic else a, 0)
            order, common = induced.suffix_order(a, width=10, limit=limit, short=0)
            suffixes = [tuple(a[i:]) for i in range(len(a))]
            assert order.tolist() == sorted(range(len(a)), key=suffixes.__getitem__)
            for x, y, c in zip(order, order[1:], common[1:]):
                equal = [p == q for p, q in zip(suffixes[x], suffixes[y])]
                assert c == min(10, [*equal, False].index(False))


@pytest.mark.parametrize("letters", [2, 7, 300, 20_000])
def test_suffix_order_of_repeated_passages(letters):
    """Long equal substrings that end at any place of a packed word, in alphabets of one to sixteen characters a word."""
    rng = np.random.default_rng(letters)
    base = rng.integers(1, letters + 1, 400)
    a = np.append(np.concatenate([base[k : k + n] for k, n in zip(rng.integers(0, 300, 120), rng.integers(5, 100, 120))]), 0)
    order, common = induced.suffix_order(a, width=14, limit=4096, short=0)
    suffixes = [tuple(a[i:].tolist()) for i in range(len(a))]
    assert order.tolist() == sorted(range(len(a)), key=suffixes.__getitem__)
    assert common[1:].tolist() == [min(14, [*map(lambda p, q: p == q, suffixes[x], suffixes[y]), False].index(False)) for x, y in zip(order, order[1:])]
    again, prefixes = induced.suffix_order(a, width=14, limit=4096)
    assert (again == order).all() and (prefixes == common).all()


def test_a_shard_far_larger_than_its_memory_bound(monkeypatch):
    """1.2 million tuples through queues of 64 kB: they spill again and again, and classes are those of a dictionary."""
    rng = np.random.default_rng(2)
    bodies = [bytes(rng.integers(97, 103, 90, np.uint8)) for _ in range(900)]
    segments = [bodies[i][a : a + 70] for i, a in zip(rng.integers(0, 900, 9000), rng.integers(0, 20, 9000))]
    raw = b"\0".join(segments) + b"\0"
    text = np.frombuffer(raw, np.uint8).astype(np.uint16) + 2
    text[np.cumsum([len(s) + 1 for s in segments]) - 1] = 1
    spills, close = [], induced._Induction.run

    def counted(self, seeds):
        out = close(self, seeds)
        spills.append(self.queue.spills)
        return out

    monkeypatch.setattr(induced._Induction, "run", counted)
    classes = {}
    for at, new in induced.equal_windows(np.append(text, np.uint16(0)), 50, 64 << 10):
        for members in np.split(at, np.flatnonzero(new)[1:]):
            inside = [m for m in members.tolist() if b"\0" not in raw[m : m + 50] and len(raw) - m >= 50]
            if inside:
                assert len(inside) == len(members)
                classes[raw[inside[0] : inside[0] + 50]] = sorted(inside)
    want = {}
    for m in range(len(raw) - 49):
        if b"\0" not in raw[m : m + 50]:
            want.setdefault(raw[m : m + 50], []).append(m)
    assert classes == want and min(spills[-2:]) > 5


def test_token_counts_stay_whole_through_retries(spark, odd):
    counts = token_counts.count_tokens(odd, queries.tokenizer_file(queries.WORD_BPE), "v1").persist()
    r = token_counts.TokenRollup(spark)
    assert r.totals().count() == 0
    assert r.commit("a", token_counts.inserts(counts)) and not r.commit("a", token_counts.inserts(counts))
    assert r.commit("b", token_counts.deletes(counts.where("doc_id = 10")))
    new = counts.where("doc_id = 4").withColumn("tokenizer", F.lit("v2"))
    assert r.commit("c", token_counts.revisions(counts.where("doc_id = 4"), new))
    total = r.totals().agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).first()
    assert (total["d"], total["t"]) == (len(TEXTS) - 1, counts.where("doc_id is null or doc_id <> 10").agg(F.sum("n_tokens")).first()[0])
    before = sorted(map(tuple, r.totals().collect()), key=repr)
    r.compact("all")
    assert sorted(map(tuple, r.totals().collect()), key=repr) == before


def test_lpt_is_the_greedy_rule():
    rng = np.random.default_rng(3)
    classes = [(int(w), int(c)) for w, c in zip(rng.choice(np.arange(1, 900), 40, replace=False), rng.integers(1, 90, 40))]
    loads = [0] * 5
    for w, c in sorted(classes, reverse=True):
        for _ in range(c):
            s = min(range(5), key=lambda i: (loads[i], i))
            loads[s] += w
    planned = [0] * 5
    for w, taken in sharding.lpt(classes, 5):
        planned = [p + w * t for p, t in zip(planned, taken)]
    assert sorted(planned) == sorted(loads)


def test_shards_keep_groups_and_slots(odd, none):
    rows = collect(sharding.shard_documents(odd, 4))
    assert len(rows) == len(TEXTS) and collect(sharding.shard_documents(none, 4)) == []
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    home = {}
    for r in rows:
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]


def test_mix_keeps_columns_and_null_sources(odd, none):
    rows = collect(mixing.mix(odd, ratio=20.0))
    assert {"copy_in", "copy", "n_copies", "mix_key"} <= set(rows[0])
    assert [r["mix_key"] for r in rows] == sorted(r["mix_key"] for r in rows)
    assert any(r["source"] is None for r in rows) and collect(mixing.mix(none)) == []
    assert {r["source"] for r in collect(mixing.mix(odd, {"s0": 1.0}, ratio=20.0))} <= {"s0"}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63, 150))] + [(200 + i, 77) for i in range(20)] + [(None, 5), (300, None)]
    codes = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in collect(topk.hamming_top_k(codes, codes.where("id % 50 = 0"), 5)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    clean = [(i, c) for i, c in rows if i is not None and c is not None]
    for q, c in clean:
        if q % 50 == 0:
            near = sorted(((c ^ o) & (2**64 - 1)).bit_count() * 10**6 + i for i, o in clean if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, v % 10**6, v // 10**6) for k, v in enumerate(near)]


@pytest.mark.parametrize("codec", sorted(tiff.CODECS.values()))
@pytest.mark.parametrize("tiles", [None, (64, 64)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(codec, tiles, predictor):
    rng = np.random.default_rng(codec)
    pages = [(rng.integers(0, 4, (200, 70), np.uint8), "one"), (np.zeros((1, 64), np.uint8), ""), (rng.integers(0, 256, (300, 64), np.uint8), "three")]
    back = list(tiff.read_pages(tiff.write_pages(pages, codec, tiles, predictor)))
    assert [p.description for p in back] == ["one", "", "three"]
    assert all((p.pixels[:, :, 0] == q).all() for p, (q, _) in zip(back, pages))


def test_media_column(spark, odd):
    stored = media.store(odd)
    rows = collect(media.digests(stored))
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))):
        b = (t or "").encode()
        padded = b + b"\0" * (-len(b) % 64) or b"\0" * 64
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    broken = spark.createDataFrame([(1, bytearray(b"II*\0junk")), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    assert {r["key"]: bool(r["error"]) for r in collect(media.pages(broken))} == {1: True, 3: True}
    assert media.pages(stored).where("doc_id is null" if False else "error is not null").count() == 0


def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    rows += [(1000 + k, " ".join(w if (j * 7 + k) % 40 else f"x{k}" for j, w in enumerate(rows[0][1].split()))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collect(near_duplicates.near_duplicates(docs, size, percent))}
        assert got == brute_groups(rows, size, percent)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = collect(near_duplicates.near_duplicates(odd, 3, 85))
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(TEXTS) and by[5]["component_id"] == 0 and by[2]["n_shingles"] == 0 and by[3]["kept"]
    assert collect(near_duplicates.near_duplicates(none)) == []


def test_large_families_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 60)
    base = [f"w{j}" for j in range(60)]
    rows = [(k, " ".join(w if (j * 11 + k * 5) % 30 else f"x{k}" for j, w in enumerate(base))) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collect(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60))}
    assert got == brute_groups(rows, 3, 60)


def test_language_of_held_out_documents(spark, odd, none):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.where("lang_pred = lang").count()
    assert right >= 0.97 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0
    model = language_id.train(docs)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in collect(language_id.identify(odd, model)) if r["doc_id"] is not None}
    assert by[2] == by[3] == by[8] == ("und", 0.0)
    assert collect(language_id.identify(none, language_id.train(none))) == []


def test_prediction_does_not_depend_on_the_batch(spark):
    model = language_id.train(documents(spark, SF))
    texts = [r["text"] for r in documents(spark, SF).limit(20).collect()]
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])


def test_sampled_pieces_round_trip_and_distribution(odd, none):
    rows = collect(pieces.encode(odd, queries.tokenizer_file(queries.PIECES)))
    assert len(rows) == len(TEXTS) and all(r["lossless"] for r in rows)
    assert collect(pieces.encode(none, queries.tokenizer_file(queries.PIECES))) == []
    s = pieces.PieceSampler(public_tokenizers.path(queries.PIECES), 0.5)
    vocabulary = {p: i for i, p in enumerate(s.spell) if p and len(p) > 0 and i > s.byte_id.max()}

    def all_of(u):
        if not u:
            yield ()
        for k in range(1, len(u) + 1):
            if u[:k] in vocabulary:
                for rest in all_of(u[k:]):
                    yield (vocabulary[u[:k]], *rest)

    ways = list(all_of(b" nation"))
    weight = np.array([np.exp(sum(s.weight[list(w)])) for w in ways])
    n = 20000
    drawn = [tuple(g.tolist()) for g in s.sample([b"nation"] * n, np.arange(n), 5)]
    share = np.array([drawn.count(w) / n for w in ways])
    assert np.abs(share - weight / weight.sum()).sum() < 0.05
    assert [tuple(g.tolist()) for g in s.sample([b"nation"], np.array([7]), 5)] == [drawn[7]]


@pytest.mark.parametrize("text", ["x     y", "  x  ", "a\n    b", "▁  ▁ "])
def test_runs_of_spaces_are_pieces(text):
    import sentencepiece

    path = public_tokenizers.path(queries.PIECES)
    s, sp = pieces.PieceSampler(path, 0.5), sentencepiece.SentencePieceProcessor(model_file=str(path))
    vocabulary = {p.encode(): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for p in [sp.id_to_piece(i).replace("▁", " ")]}
    vocabulary |= {b"\n": s.byte_id[10]}

    def all_of(u):
        if not u:
            yield ()
        if u.startswith("▁".encode()):  # an original bar has byte pieces only
            for rest in all_of(u[3:]):
                yield (*s.byte_id[list(u[:3])].tolist(), *rest)
        for k in range(1, len(u) + 1):
            if u[:k] in vocabulary:
                for rest in all_of(u[k:]):
                    yield (int(vocabulary[u[:k]]), *rest)

    ways = list(all_of(b" " + text.encode()))
    if "▁" not in text:
        assert tuple(sp.encode(text)) in ways
    weight = np.array([np.exp(sum(s.weight[list(w)])) for w in ways])
    n = 60000
    drawn = [tuple(g.tolist()) for g in s.sample([text.encode()] * n, np.arange(n), 5)]
    assert set(drawn) <= set(ways) and s.decode(np.array(drawn[0])) == text.encode()
    share = np.array([drawn.count(w) / n for w in ways])
    assert np.abs(share - weight / weight.sum()).sum() < 0.05


def test_lattices_of_known_words_are_kept(monkeypatch):
    s = pieces.PieceSampler(public_tokenizers.path(queries.PIECES), 0.5)
    built, lattice = [], s._lattice
    monkeypatch.setattr(s, "_lattice", lambda buf, skip, starts, size: built.append(len(starts)) or lattice(buf, skip, starts, size))
    texts = [b"the nation and the nation", b"", "x  y ▁z 語".encode(), b"the end"]
    keys = np.arange(len(texts))
    first = [g.tolist() for g in s.sample(texts, keys, 5)]
    assert built == [9]  # the nation and, the empty word, x, y with a second space, z with its bar, 語, end
    assert [g.tolist() for g in s.sample(texts, keys, 5)] == first and built == [9]
    assert [s.sample([t], keys[k : k + 1], 5)[0].tolist() for k, t in enumerate(texts)] == first and built == [9]
    # With room for a few words only, lattices are built again and the draws stay.
    monkeypatch.setattr(pieces, "STORE", 40)
    assert [s.sample([t], keys[k : k + 1], 5)[0].tolist() for k, t in reversed(list(enumerate(texts)))] == first[::-1]
    assert len(built) > 1 and s.nodes <= 80


_MEMORY = """
import re
import numpy as np
from loomstead.llm import pieces, queries
held = lambda: int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
queries.tokenizer_file(queries.PIECES)
before = held()
s = pieces.PieceSampler(queries.tokenizer_file(queries.PIECES), 1.0)
letters, most = np.random.default_rng(1), 0
for _ in range(40):
    text = letters.integers(97, 123, (12000, 8), np.uint8)
    text[:, 7] = 32
    s.sample([text.tobytes()], np.array([1]), 5)
    most = max(most, held() - before)
s.forget()
print(most, s.nodes, len(s.number), s.edges.n)
"""


def test_a_worker_holds_little_memory():
    """A full store of lattices and the sampler's tables, in MB; nothing is kept once a task has ended."""
    said = subprocess.run([sys.executable, "-c", _MEMORY], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert float(said[0]) < 200 and said[1:] == ["0", "0", "0"]


def test_lattices_go_with_the_task(monkeypatch, spark, odd):
    ran = []
    monkeypatch.setattr(pieces, "tidy", lambda run: ran.append(run) or run)
    path = queries.tokenizer_file(queries.PIECES)
    pieces.encode(odd, path)
    rows = ran[0](iter([pd.DataFrame({"doc_id": [1], "copy": [0], "t": [b"the nation"]})]))
    assert next(rows)["lossless"].all() and pieces.sampler(path, 1.0).nodes
    assert list(rows) == [] and not pieces.sampler(path, 1.0).nodes


def test_a_broken_character_leaves_its_neighbours_whole():
    s = pieces.PieceSampler(public_tokenizers.path(queries.PIECES), 0.5)
    letter = s.spell.index(b"a", int(s.byte_id.max()) + 1)
    drawn = {tuple(g.tolist()[-2:]) for g in s.sample([b"\xe2a"] * 2000, np.arange(2000), 5)}
    assert drawn == {(int(s.byte_id[0xE2]), letter)}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("not lossless").count() == 0 and last.count() == docs.count()


def _joins_of(monkeypatch, run, *modules):
    """The plans of all tables that ``run`` writes between steps, and of its result."""
    plans = []
    for m in modules:
        monkeypatch.setattr(m, "kept", lambda df, what, f=m.kept: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, what))
    out = run()
    return [*plans, out._jdf.queryExecution().executedPlan().toString()]


def test_near_duplicates_broadcast_no_growing_table(spark, monkeypatch):
    plans = _joins_of(monkeypatch, lambda: near_duplicates.near_duplicates(documents(spark, SF), size=3, percent=85), near_duplicates, graph)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("stage", ["without_near_duplicates", "without_repeats"])
def test_stages_broadcast_no_growing_table(spark, stage):
    from loomstead.llm import stages

    plan = getattr(stages, stage)(spark, documents(spark, SF), SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_text_is_cut_once(spark):
    from loomstead.llm import stages

    plan = stages.without_repeats(spark, documents(spark, SF), SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1
