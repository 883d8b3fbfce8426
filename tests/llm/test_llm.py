"""Every operator against a brute-force version, and on null, empty, long, tied, repeated and clashing input."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.llm import chat, common, embedding, exchange, forest, media, mixing, neardup, packing, pretoken, quality, sharding, substring, tokens

DOC = "doc_id bigint, text string, key string, n bigint"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "st", "nd", "lp")]


def text_of(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(len(WORDS), size=n))


def docs(spark, items):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in items], DOC)


ODD = [(0, None), (1, ""), (2, "   \n\t "), (3, "One two, three!"), (3, "One two, three!"), (None, "no id"), (5, "naïve café ßtraße 東京 <|endoftext|> İx\x00y   é"), (6, "It's 10% of WE'LL don't—ok"), (7, text_of(1, 9000)), (8, "<|startoftext|>a b")]


def library_ids(t):
    return pretoken.tokenizer(tokens.default_path()).encode(t or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark):
    got = tokens.count_tokens(docs(spark, ODD), table_size=20).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library_ids(t))) for i, t in ODD)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert tokens.count_tokens(docs(spark, [])).count() == 0


def test_the_memo_forgets_and_stays_exact():
    memo = pretoken.Memo(tokens.default_path(), len, {"the": 1}, bound=3)
    words = ["the", "river", "xqzv", "école", "the", "river", "qqqqqq", "zz9", "river"]
    assert [memo[w] for w in words] == [len(library_ids(w)) for w in words] and len(memo) <= 4


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    out = packing.pack(docs(spark, ODD), capacity=capacity, group_rows=4, keep_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in out:
        assert 0 < r.length <= capacity and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in ODD:
        whole = np.array(library_ids(t) + [2], "<u4").tobytes()
        rows = sorted(by_doc[i])[:: 2 if i == 3 else 1]
        assert b"".join(x[1] for x in rows) == whole and all(x[2] == len(whole) // 4 for x in rows)
    assert packing.pack(docs(spark, [])).count() == 0


def test_first_fit_decreasing_equals_a_plain_scan():
    lengths = np.random.default_rng(2).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room.extend([100] * (k == len(room)))
        want[i] = (k, 100 - room[k])
        room[k] -= lengths[i]
    assert all((bins[i], offsets[i]) == want[i] for i in range(300))


CHAT = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "~1 ~0 <s>[TURN] x [/TURN]\n", None, "", "plain\n", "a~"]
    rows = [(1, k, ("user", "assistant")[k % 2], t, "x") for k, t in enumerate(said)] + [(2, 0, "assistant", "b", "x"), (2, 0, "assistant", "b", "x"), (None, 1, None, None, None), (4, None, "user", "q", "x"), (4, 1, "assistant", "r", "x"), (5, 0, "system", "s", "x"), (5, 1, "user", "s", "x")]
    out = chat.format_chats(spark.createDataFrame(rows, CHAT)).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(said)]
    assert [s.loss for s in got[1].segments if s.part == "text"] == [False, True] * 3 and not any(s.loss for s in got[1].segments if s.part != "text")
    assert [s.part for s in got[1].segments] == ["open", "text", "close"] * 6 and "".join(s.text for s in got[1].segments) == got[1].formatted
    assert got[1].valid_order and not got[2].valid_order and got[2].n_turns == 2 and got[4].valid_order and not got[5].valid_order
    assert [(t.role, t.text) for t in got[None].back] == [("", "")]
    body = got[1].formatted.split("[/TURN]\n")[1].rsplit("</s>\n", 1)[0]
    assert not any(c in body for c in chat.Template().controls)


def test_sharding(spark):
    rng = np.random.default_rng(5)
    items = [(i, "same text " * 5 if i % 3 == 0 else text_of(i, int(rng.integers(1, 60)))) for i in range(3000)] + [(7000, None), (7001, ""), (7001, ""), (None, "x")]
    got = sharding.shard(docs(spark, items), 8, 0.01).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t in items)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    mean = sum(r.size for r in got) / 8
    assert max(abs(sum(r.size for r in got if r.shard == s) - mean) for s in range(8)) <= 2 * max(0.01 * mean, max(r.size for r in got))
    assert sharding.shard(docs(spark, [])).count() == 0


def test_media_round_trip(spark):
    items = [*ODD, (20, "z" * 576), (21, "z" * 577)]
    got = media.media_columns(docs(spark, items)).collect()
    assert len(got) == len(items)
    by = {r.doc_id: r for r in got}
    for i, t in items:
        data, r = (t or "").encode(), by[i]
        payload = media.from_wav(bytes(r.media))
        assert payload[: len(data)] == data and set(payload[len(data) :]) <= {255} and len(payload) % 576 == 0 and len(payload) == max(576, -(-len(data) // 576) * 576)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert list(r.codes) == sorted(r.codes)
    assert by[0].codes == by[1].codes != by[7].codes


def test_peaks_of_a_tone():
    t = np.arange(576 * 4)
    found = media.peaks((128 + 100 * np.sin(2 * np.pi * 48 * t / 576)).astype(np.uint8), block=3)
    assert (found[:, 1] == 48).all()


def brute_components(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 420)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = brute_components({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if n in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


def near_items():
    items, rng = [], np.random.default_rng(6)
    for g in range(12):
        base = text_of(100 + g, 120).split()
        for c in range(5):
            w = list(base)
            for k in rng.integers(len(w), size=c):
                w[k] = f"edit{c}"
            items.append((len(items) + 10, " ".join(w).upper() if c == 1 else " ".join(w)))
    hot = text_of(999, 200).split()
    for c in range(60):
        w = list(hot)
        w[c * 3] = f"hot{c}"
        items.append((1000 + c, " ".join(w)))
    return items + [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, " \n"), (5, "one three"), (10, items[0][1])]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    items = near_items()
    got = neardup.near_duplicates(docs(spark, items + [(None, "one two")]), width=width).collect()

    def shingled(t):
        w = common.ascii_words(t)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {i: shingled(t) for i, t in items}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(ids, links)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((i, len(sets[i]), want[i], want[i] == i) for i, _ in items)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None][0][1]


def test_a_star_of_near_copies_is_one_component(spark):
    base, rng = text_of(321, 104).split(), np.random.default_rng(14)
    spokes = []
    for c in range(600):
        w = list(base)
        for k in rng.choice(np.arange(4, 100), 2, replace=False):
            w[k] = f"s{c}x{k}"
        spokes.append((c, " ".join(w)))
    items = [*spokes, (600, " ".join(base))]
    sets = {i: set(neardup.shingle_sets(pa.array([t]), 5)[0].tolist()) for i, t in items}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sorted(sets), links)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, items)).collect()}
    assert sum((600, c) in links or (c, 600) in links for c in range(600)) > 500 and got == want


def test_common_counts_equal_sets():
    rng = np.random.default_rng(15)
    x = [np.unique(rng.integers(0, 9000, k).astype(np.uint64)) for k in (0, 1, 50, 3000, 8000)]
    assert forest.common_counts(x, x[1:]).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in x[1:]] for a in x]


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert [r.kept for r in neardup.near_duplicates(docs(spark, [(1, None), (2, None)])).collect()] == [True, True]


def test_jaccard_at_the_threshold():
    x = np.arange(9, dtype=np.uint64)
    assert common.jaccard_at_least(x, np.arange(8, dtype=np.uint64), 80) and common.jaccard_at_least(x[:4], np.arange(5, dtype=np.uint64), 80)
    assert not common.jaccard_at_least(x, np.arange(1, 10, dtype=np.uint64), 81) and not common.jaccard_at_least(x[:0], x[:0], 80)


def test_regions_are_connected_across_partitions(spark):
    rows = [(0, 5, i, 100) for i in range(300)] + [(0, -7, i, 100) for i in range(500, 505)]
    pairs = forest.forest_pairs(common.keep(spark.createDataFrame(rows, "tree bigint, path bigint, id bigint, n bigint")), 5, 4, 80, 7).collect()
    label = brute_components([r[2] for r in rows], [(p.a, p.b) for p in pairs])
    assert {label[i] for i in range(300)} == {0} and {label[i] for i in range(500, 505)} == {500} and len(pairs) < 300 * 8


def test_passages(spark):
    passage = text_of(50, 70)
    host = {i: text_of(200 + i, 90) for i in range(8)}
    put = lambda i, k: " ".join(host[i].split()[:k]) + " " + passage + "\n" + " ".join(host[i].split()[k:])
    long = "\n".join(text_of(900 + k, 100) for k in range(40))
    items = [(1, put(1, 30)), (2, put(2, 0)), (3, put(3, 90)), (4, host[4]), (5, host[5]), (6, None), (7, ""), (8, passage), (9, long), (10, long), (5, host[5]), (None, passage)]
    got = substring.deduplicate_passages(docs(spark, items), columns=["key", "n"]).collect()
    assert len(got) == len(items) and all((r.others.key, r.others.n) == ("clash", 7) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == 0 and by[1].clean == put(1, 30) and by[4].clean == host[4] and by[5].clean == host[5] and by[6].clean is None and by[9].clean == long
    assert by[2].clean.split() == host[2].split() and by[3].clean.split() == host[3].split() and by[8].clean == "" and by[10].clean == ""
    assert by[1].cluster_id == by[2].cluster_id == by[3].cluster_id == by[8].cluster_id == 1 and by[10].cluster_id == 9 and by[4].cluster_id == 4
    assert by[None].clean == passage and substring.deduplicate_passages(docs(spark, [])).count() == 0


def test_a_passage_with_one_changed_word(spark):
    w = text_of(60, 120).split()
    changed = list(w)
    changed[100] = "other"
    items = [(1, text_of(61, 40) + " " + " ".join(w)), (2, " ".join(changed) + " " + text_of(62, 40)), (3, " ".join(w[:30]) + " " + text_of(63, 80))]
    by = {r.doc_id: r for r in substring.deduplicate_passages(docs(spark, items)).collect()}
    assert by[2].n_removed >= 100 and by[3].n_removed == 0


def test_near_copies_of_a_paragraph_are_found_wherever_they_differ(spark):
    items = []
    for k in range(150):
        w = text_of(2000 + k, 50).split()
        at = k % 50
        edited = (w[:at] + ["other"] + w[at + 1 :], w[:at] + ["more"] + w[at:], w[at:] + w[:at])[k // 50]
        items += [(2 * k, f"{text_of(3000 + k, 20)} {' '.join(w)}"), (2 * k + 1, f"{' '.join(edited)} {text_of(4000 + k, 20)}")]
    sets = {i: common.shingles(common.word_ids(common.ascii_words(t)), 5) for i, t in items}
    want = {2 * k + 1 for k in range(150) if brute_windows(sets[2 * k + 1], sets[2 * k])}
    by = {r.doc_id: r for r in substring.deduplicate_passages(docs(spark, items)).collect()}
    assert len(want) > 140 and {i for i, r in by.items() if r.n_removed} == want == {i for i, r in by.items() if r.cluster_id != i}


def brute_windows(hx, hy, window=46, percent=80):
    sets = [set(hy[t : t + window].tolist()) for t in range(len(hy) - window + 1)]
    mine = [set(hx[i : i + window].tolist()) for i in range(len(hx) - window + 1)]
    return [i for i, a in enumerate(mine) if any(100 * len(a & b) >= percent * len(a | b) for b in sets)]


def test_a_paragraph_of_scattered_lines_is_no_repeat(spark):
    one, two = text_of(70, 25), text_of(71, 25)
    items = [(1, " ".join([text_of(72, 30), one, text_of(73, 80), two, text_of(74, 30)])), (2, f"{one} {two}")]
    got = {r.doc_id: r for r in substring.deduplicate_passages(docs(spark, items)).collect()}
    assert got[2].n_removed == 0 and got[2].cluster_id == 2


def test_passages_in_a_dense_group_equal_brute_force(spark):
    """A line that every document has, and passages that go on from it in two documents each, exact or with one edit."""
    line, items, want = text_of(80, 38).split(), [], {}
    for k in range(200):
        more = text_of(5000 + k, 14).split()
        at, edit = len(line) + k % 7 - 3, k % 4
        mine = line + more
        other = (mine, mine[:at] + ["other"] + mine[at + 1 :], mine[:at] + ["more"] + mine[at:], mine[:at] + mine[at + 1 :])[edit]
        items += [(2 * k, " ".join([text_of(6000 + k, 15), *mine, text_of(7000 + k, 9)])), (2 * k + 1, " ".join([text_of(8000 + k, 9), *other, text_of(9000 + k, 15)]))]
    sets = {i: common.shingles(common.word_ids(common.ascii_words(t)), 5) for i, t in items}
    want = {2 * k + 1 for k in range(200) if brute_windows(sets[2 * k + 1], sets[2 * k])}
    by = {r.doc_id: r for r in substring.deduplicate_passages(docs(spark, items)).collect()}
    found = {i for i, r in by.items() if r.n_removed}
    assert found <= want and len(want) > 150 and len(want - found) <= 0.02 * len(want)
    assert all(45 <= by[i].n_removed <= 54 for i in found) and {i for i, r in by.items() if r.cluster_id != i} == found


def test_texts_of_one_key_and_hot_groups(spark):
    passage = text_of(81, 60)
    items = [(1, f"{passage} {text_of(82, 30)}"), (2, f"{text_of(83, 60)}"), (2, f"{text_of(84, 10)} {passage}"), (3, text_of(83, 60))] + [(10 + i, f"{text_of(100 + i, 5)} {passage}") for i in range(400)]
    got = substring.deduplicate_passages(docs(spark, items)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id == 2) == [(60, 0), (70, 60)]
    assert all(60 <= r.n_removed <= 65 and r.cluster_id == 1 for r in got if r.doc_id >= 10) and {r.n_removed for r in got if r.doc_id == 3} == {60}


def test_keys_joined_instead_of_filtered(spark, monkeypatch):
    passage = text_of(85, 64).split()
    items = [(1, " ".join(passage)), (2, " ".join([*passage[:30], "other", *passage[31:]])), (3, text_of(86, 70))]
    monkeypatch.setattr(substring, "FILTER_BITS", 0)
    by = {r.doc_id: r.n_removed for r in substring.deduplicate_passages(docs(spark, items)).collect()}
    assert by == {1: 0, 2: 64, 3: 0}


def test_a_key_filter_finds_its_keys_and_hardly_any_others(spark):
    keys = np.random.default_rng(5).integers(0, 2**63, 200_000, dtype=np.uint64)
    own, others = keys[:26_000], keys[26_000:]
    rows = spark.createDataFrame([(int(k),) for k in own], "key bigint")
    found = exchange.key_filter(rows, len(own))
    assert found.has(own).all() and found.has(others).mean() < 0.001


def test_an_exchange_folds_and_scans_whole_groups_a_few_megabytes_at_a_time(spark):
    def make(part):
        for seed in part.column("key").to_pylist():
            keys = np.random.default_rng(seed).integers(0, 50_000, 100_000).astype(np.uint64)
            yield 0, [keys, np.full(len(keys), seed), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)]

    said = lambda kind, keys: [np.array([n], np.int64) for n in (kind, len(keys), len(np.unique(keys)))]
    fold = lambda kind, columns: (said(0, columns[0]), columns)
    scan = lambda kind, columns: said(1, columns[0])
    rows = spark.createDataFrame([(k, "word") for k in range(8)], "key bigint, text string").coalesce(1)
    found = exchange.exchange(rows, make, fold, scan, ["<u8", "<i8", "<u4", "<u4"], "side bigint, n bigint, groups bigint", 1).collect()
    for side in (0, 1):
        assert sum(r.n for r in found if r.side == side) == 800_000 and max(r.n for r in found if r.side == side) * 24 < 10 << 20
    assert sum(r.groups for r in found if r.side == 1) == len(np.unique(np.concatenate([np.random.default_rng(k).integers(0, 50_000, 100_000) for k in range(8)])))


def test_least_positions_equal_a_plain_scan():
    h = np.random.default_rng(8).integers(0, 2**63, 500, dtype=np.uint64)
    want = sorted({int(i + np.argmin(h[i : i + 46])) for i in range(len(h) - 45)})
    assert substring.least_positions(h, 46).tolist() == want and len(substring.least_positions(h[:45], 46)) == 0


def test_quality(spark):
    rng = np.random.default_rng(9)
    bad = lambda s: " ".join(w.upper() + "!!" for w in text_of(s, 40).split())
    items = [(i, bad(i) if i % 4 == 0 else text_of(i, int(rng.integers(30, 80)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1), (3, None), (5, 0)], "doc_id bigint, quality int")
    d = docs(spark, items + [(900, None), (901, ""), (3, items[3][1]), (None, "x")])
    model = quality.train(d, labels, max_rows=250, trees=40)
    got = quality.score(d, model, columns=["key"]).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.others.key == "clash" for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id < 400 and r.doc_id != 5]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert quality.score(d, quality.train(d, labels.where("false"))).first().score == 0.5
    assert quality.score(docs(spark, []), model).count() == 0


def test_flat_trees_equal_plain_descent():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 5))
    model = quality.fit(x, (x[:, 1] + x[:, 3] > 0).astype(float), trees=15, depth=3)
    for row, score in zip(x[:50], model.score(x[:50])):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


VEC = "vec_id bigint, embedding array<float>, label int, key string"


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(v)) for v in base[i % 40] + rng.normal(scale=(0.03, 0.08, 0)[i % 3], size=16)], i % 2, "x") for i in range(400)]
    odd = [(500, None, 0, "x"), (501, [0.0] * 16, 0, "x"), (502, [float("nan")] + [1.0] * 15, 0, "x"), (503, [None] + [1.0] * 15, 0, "x"), (504, rows[2][1], None, "x"), (505, [1.0, 2.0], 0, "x"), (506, [2.0, 4.0], 0, "x"), (507, [], 0, "x"), (508, [float("inf")] * 16, 0, "x")]
    got = {r.vec_id: r for r in embedding.near_vectors(spark.createDataFrame(rows + odd + [(None, rows[2][1], 0, "x")], VEC), sample_rows=64, max_lists=6, subspaces=4).collect()}
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    links = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.98] + [(505, 506)]
    want, n = brute_components([r[0] for r in rows + odd], links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    assert len(links) > 300
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None} == {i: (n.get(i, 0), c, c == i) for i, c in want.items()}
    assert got[None].n_links == 0 and embedding.near_vectors(spark.createDataFrame([], VEC)).count() == 0


@pytest.mark.parametrize("d", [12, 64])
def test_index_recall(d):
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rng.normal(size=(2000, d)))
    y = unit(x + rng.normal(scale=0.17 / np.sqrt(d), size=x.shape))
    ix, radius = embedding.fit(x[:500], 12, 6, 32), np.sqrt(2 - 2 * 0.98)
    (ax, _, _), (ay, codes, err) = ix.encode(x), ix.encode(y)
    near = (x * y).sum(axis=1) >= 0.98
    rows = np.arange(len(x))
    found = np.where(ax <= ay, ix.probes(x, ax, radius)[rows, ay], ix.probes(y, ay, radius)[rows, ax])
    table = np.array([ix.table_distances(x[i : i + 1], ay[i], codes[i : i + 1])[0, 0] for i in rows])
    assert near.sum() > 1000 and (ax != ay)[near].sum() > 20
    assert (table <= radius + err + 1e-6)[near].all() and (found[near].all() if d <= 16 else found[near].mean() > 0.995)


@pytest.mark.parametrize("directions", [2, 4, 8])
def test_probes_lose_no_link_of_a_flat_cluster(directions):
    rng = np.random.default_rng(16)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    span = rng.normal(size=(directions, 64)) / 8
    x = unit(2 * unit(rng.normal(size=(1, 64))) + rng.normal(size=(1500, directions)) @ span * 0.5 / np.sqrt(directions))
    ix, radius = embedding.fit(x, 40, 16, 32), np.sqrt(2 - 2 * 0.98)
    at = ix.encode(x)[0]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    to = ix.probes(x, at, radius)
    assert (at[a] != at[b]).sum() > 100 and np.where(at[a] <= at[b], to[a, at[b]], to[b, at[a]]).all()


def test_mixing(spark):
    bad = lambda s: " ".join(w + "***" for w in text_of(s, 50).split())
    items = [(i, bad(i) if i % 4 == 0 else text_of(i, 60)) for i in range(600)]
    labels = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "good") for i in range(0, 600, 2)] + [(None, "bad"), (1, None), (3, "unknown")], "doc_id bigint, domain string")
    d = docs(spark, items + [(900, None), (901, ""), (3, items[3][1])])
    got = mixing.mix(d, labels, {"good": 0.9, "bad": 0.1}, columns=["text", "key"]).collect()
    tokens_of = sum(r.n_tokens for r in got)
    for name, share in (("good", 0.9), ("bad", 0.1)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in got) / tokens_of - share) < 1e-3
    assert len(got) == 603 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) and r.others.key == "clash" and r.miss <= 1e-3 for r in got)
    assert np.mean([(r.p_bad > 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id < 600]) > 0.99
    capped = mixing.mix(d, labels, {"good": 0.98, "bad": 0.02}, anchor="good", keep_whole=("good",), most=1.0).collect()
    assert all(r.copies == 1 for r in capped if r.p_good > 0.5) and sum(r.copies for r in capped if r.p_bad > 0.5) < 100
    even = mixing.mix(d, labels.where("false"), {"good": 0.5, "bad": 0.5}).first()
    assert even.p_good == even.p_bad == 0.5 and mixing.mix(docs(spark, []), labels, {"good": 0.5, "bad": 0.5}).count() == 0


def test_literal_rows(spark):
    assert [tuple(r) for r in common.literal_rows(spark, [(1, 2**62), (3, -4)], "a int, b bigint").collect()] == [(1, 2**62), (3, -4)]


def test_word_hashes_equal_plain_words(monkeypatch):
    texts = ["Hello  World foo", None, "", "  ", "a", "foo\tBAR\n", "x" * 5000 + " " + "X" * 5000 + " foo", "naïve É é", "end", "start bar", "\x0b\x0cq\x00r s"]
    ids, at = common.words_of(pa.array(texts))
    words = [common.ascii_words(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len({(w, h) for w, h in zip(flat, ids.tolist())}) == len(set(flat)) == len(set(ids.tolist()))
    part, start = common.words_of(pa.array(texts).slice(3, 5))
    assert part.tolist() == ids[at[3] : at[8]].tolist() and start[-1] == len(part)
    monkeypatch.setattr(common, "SEGMENT", 50)
    assert common.words_of(pa.array(texts))[0].tolist() == ids.tolist() and len(common.words_of(pa.array([], pa.string()))[0]) == 0


def test_codes_equal_a_plain_transform():
    """Peaks by a plain Fourier sum of each frame, and all their pairs one by one."""
    rng = np.random.default_rng(21)
    samples = rng.integers(0, 256, 576 * 3).astype(np.uint8)
    wave_, n = np.hanning(577)[:-1], np.arange(576)
    frames = [(samples[s : s + 576].astype(float) - 128) * wave_ for s in range(0, 576 * 3 - 575, 288)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(289), n) / 576)
    power = np.abs(np.array(frames) @ turn.T)
    want = [[lo + int(np.argmax(p[lo:hi])) for lo, hi in media.BANDS] for p in power]
    assert media.peaks(samples, 2).tolist() == want
    codes = sorted(t << 24 | want[t][k] << 14 | want[t + ahead][(k + b) % 3] << 4 | ahead for ahead, b in media.TARGETS for t in range(len(want) - ahead) for k in range(3))
    assert media.time_codes(np.array(want)).tolist() == codes


def test_rates_equal_a_plain_projected_gradient(spark):
    items = [(i, text_of(i, 20 + i % 50) if i % 3 else " ".join(w + "***" for w in text_of(i, 30).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, "good" if i % 3 else "bad") for i in range(0, 300, 2)], "doc_id bigint, domain string")
    got = mixing.mix(docs(spark, items), labels, {"good": 0.6, "bad": 0.4}).collect()
    n, p = np.array([r.n_tokens for r in got], float), np.array([[r.p_good, r.p_bad] for r in got])
    have, rate = n @ p, np.ones(len(got))
    want = have.sum() * np.array([0.6, 0.4])
    for _ in range(4000):
        rate = np.maximum(0, rate - p @ (((n * rate) @ p - want) / have))
    assert np.abs((n * rate) @ p - want).max() < 1 and np.abs(rate - [r.rate for r in got]).max() < 0.01
    never = mixing.mix(docs(spark, items), labels, {"good": 0.05, "bad": 0.95}, most=1.0).first()
    assert never.miss > 0.1


@pytest.mark.parametrize("seed", [1, 2])
def test_a_tree_split_equals_the_best_of_all_thresholds(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 30, (200, 4)).astype(float), rng.integers(0, 2, 200).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, bins=64, l2=1.0)
    g, h = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))
    g, h = y - 1 / (1 + np.exp(-model.base)), np.full(200, 1 / (1 + np.exp(-model.base)) * (1 - 1 / (1 + np.exp(-model.base))))
    gain = lambda m: sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (m, ~m))
    best = max(gain(x[:, j] > t) for j in range(4) for t in np.unique(x[:, j])[:-1])
    assert abs(gain(x[:, model.feature[0, 0]] > model.threshold[0, 0]) - best) < 1e-9
    left, right = (0.1 * g[m].sum() / (h[m].sum() + 1) for m in (x[:, model.feature[0, 0]] <= model.threshold[0, 0], x[:, model.feature[0, 0]] > model.threshold[0, 0]))
    assert np.allclose(model.leaf[0], [left, right])


def test_splitters_equal_sorted_rows(spark):
    """Shards are runs of the rows in key order, cut where the bytes reach each share."""
    items = [(i, text_of(i % 700, 5 + i % 40)) for i in range(2500)]
    got = sorted(sharding.shard(docs(spark, items), 8, 0.01).collect(), key=lambda r: r.order % 2**64)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    size, slots = np.cumsum([r.size for r in got]), {}
    for r in got:
        assert r.slot == slots.setdefault(r.shard, 0)
        slots[r.shard] += 1
    ends = [max(k for k, r in enumerate(got) if r.shard == s) for s in range(7)]
    assert all(abs(size[e] - size[-1] * (s + 1) / 8) <= max(0.01 * size[-1] / 8, max(r.size for r in got)) for s, e in enumerate(ends))
    texts = [r.text_crc32 for r in got]
    assert sum(a != b for a, b in zip(texts, texts[1:])) == len(set(texts)) - 1


CLASHES = ["score", "predicted", "held_out", "clean", "n_removed", "n_words", "spans", "cluster_id", "rate", "copies", "n_tokens", "p_good", "miss", "key", "others", "n", "keys", "tags"]


def test_results_clash_with_no_column(spark):
    items = [(i, text_of(i, 60) if i % 3 else text_of(i, 30).upper() + " !!! ### ***") for i in range(60)] + [(70, text_of(1, 60))]
    d = docs(spark, items).select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    for got in (
        quality.score(d, quality.train(d, labels, trees=5), columns=d.columns),
        substring.deduplicate_passages(d, columns=d.columns),
        mixing.mix(d, mixing.label_domains(labels), {"good": 0.5, "poor": 0.5}, columns=d.columns),
    ):
        rows = got.select("others.*").collect()
        assert len(rows) == len(items) and all(r[c] == f"own {c}" for r in rows for c in CLASHES) and {(r.doc_id, r.text) for r in rows} == set(items)
    for done in (neardup.near_duplicates(d), packing.pack(d), tokens.count_tokens(d), media.media_columns(d), sharding.shard(d)):
        assert done.select("doc_id").distinct().count() == len(items)


def test_empty_tables_and_very_long_texts(spark):
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == media.media_columns(docs(spark, [])).count() == neardup.near_duplicates(docs(spark, [])).count() == 0
    long = text_of(5, 300_000)
    items = [(1, long), (2, long + " tail"), (3, "short one"), (4, "y" * 3_000_000)]
    d = docs(spark, items)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.score(d, quality.train(d, labels, trees=3)).count() == 4
    assert {r.doc_id: r.n_tokens for r in mixing.mix(d, mixing.label_domains(labels), {"good": 0.5, "poor": 0.5}).collect()} == {1: 300_000, 2: 300_001, 3: 2, 4: 1}
    assert {r.doc_id: r.n_removed for r in substring.deduplicate_passages(d).collect()} == {1: 0, 2: 300_000, 3: 0, 4: 0}


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(31)
    rows = []
    for d in range(2, 82):
        v = rng.normal(size=d)
        rows += [(10 * d, v.tolist(), 0, "x"), (10 * d + 1, (v * 2).tolist(), 0, "x"), (10 * d + 2, (-v).tolist(), 0, "x")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_vectors(spark.createDataFrame(rows, VEC), indexes=2).collect()}
    assert got == {10 * d + k: ((1, 1, 0)[k], 10 * d + (0, 0, 2)[k]) for d in range(2, 82) for k in range(3)}


@pytest.mark.parametrize("d", [64, 768])
def test_pairs_that_point_at_a_foreign_centroid(d):
    rng = np.random.default_rng(32)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(600, d)))
    ix, radius = embedding.fit(x, 32, 16, 32), np.sqrt(2 - 2 * 0.98)
    at = ix.encode(x)[0]
    to = (at + 1 + rng.integers(0, 31, 600)) % 32
    way = ix.centroids[to] - ix.centroids[at]
    y = unit(x + unit(way - (way * x).sum(axis=1)[:, None] * x) * 0.2)
    other = ix.encode(y)[0]
    near = (x * y).sum(axis=1) >= 0.98
    rows = np.arange(600)
    found = np.where(at <= other, ix.probes(x, at, radius)[rows, other], ix.probes(y, other, radius)[rows, at])
    assert near.sum() > 500 and (at != other)[near].sum() > 20 and found[near].all()
