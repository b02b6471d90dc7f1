"""The ten operators against brute force, round trips and hard cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from tessella.llm import bitplane, bpe_count, main_text, mixing, multiset_hash, piece_automaton, postings, simhash, toxicity, winnow
from tessella.llm.common import table

HARD = ["", None, " ", "a", "  two  spaces ", "line\n\nline\n", "\t tab nbsp", "<|endoftext|> in a <|endoftext|>text", "don't we're it's", "日本語 テキスト", "é́ combining", "☃𝒳", "▁▁ marks ▁", "x" * 5000, "a b " * 3000, "same", "same", "THE!! END!!", "12 345 6789", "\x00\x01"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en", "s", None, "extra") for i, t in enumerate(HARD)] + [(3, "again id 3", None, None, 1, None), (None, "no id", "en", "s", 5, ""), (3, "a", "en", "s", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def empty(hard):
    return hard.where("false")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- tokens


def test_counts_equal_the_library(docs, hard, empty):
    t = bpe_count.load(bpe_count.tokenizer_path())
    for df in (docs, hard):
        found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.count_tokens(df).collect())
        wanted = sorted((d or -1, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for d, x in texts_of(df))
        assert found == wanted
    assert bpe_count.count_tokens(empty).count() == 0


def test_whole_tokens_are_proved(spark):
    whole = bpe_count.whole_tokens(bpe_count.tokenizer_path())
    t = bpe_count.load(bpe_count.tokenizer_path())
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole and " the" in whole
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 300))


def test_a_small_memo_gives_the_same(hard):
    small = sorted((r.doc_id or -1, r.n_tokens) for r in bpe_count.count_tokens(hard, remembered=3).collect())
    assert small == sorted((r.doc_id or -1, r.n_tokens) for r in bpe_count.count_tokens(hard).collect())


def ids_by_library(df):
    t = bpe_count.load(bpe_count.tokenizer_path())
    return [(d, [*t.encode(x, add_special_tokens=False).ids, 2]) for d, x in sorted(texts_of(df), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))]


def test_id_files_hold_the_librarys_ids(docs, hard, empty):
    for df in (docs, hard):
        at, wanted = 0, []
        for d, ids in ids_by_library(df):
            wanted.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        found = [tuple(r)[:4] for r in bitplane.token_id_files(df).collect()]
        key = lambda r: (r[1],)
        assert sorted(found, key=key) == sorted(wanted, key=key)
    assert bitplane.token_id_files(empty).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(tmp_path, kind):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 1 << 32, n).astype("<u4") for n in (0, 1, 7, 250, 1000, 3)]
    with open(tmp_path / "f", "wb") as f:
        w = bitplane.PlaneWriter(f, kind, block=100)
        for i, x in enumerate(lists):
            w.add(i if i != 2 else None, x.tobytes())
        assert w.close() == sum(map(len, lists))
    with open(tmp_path / "f", "rb") as f:
        r = bitplane.PlaneReader(f, (tmp_path / "f").stat().st_size)
        assert [(d, b) for d, b in r.docs()] == [(i if i != 2 else None, x.tobytes()) for i, x in enumerate(lists)]
        assert all(r.doc(i) == x.tobytes() for i, x in enumerate(lists))


def test_a_cut_file_is_refused(tmp_path):
    (tmp_path / "f").write_bytes(b"TSPL1 something that is not a file")
    with open(tmp_path / "f", "rb") as f, pytest.raises(ValueError):
        bitplane.PlaneReader(f, 34)


def test_pieces_equal_the_library(docs, hard, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_automaton.model_path())
    for df in (docs, hard):
        found = sorted((r.doc_id or -1, r.n_tokens, list(r.ids)) for r in piece_automaton.piece_codes(df, ids=True).collect())
        assert found == sorted((d or -1, len(x), x) for d, x in ((d, sp.encode(t)) for d, t in texts_of(df)))
    assert piece_automaton.piece_codes(docs).where("not lossless").count() == 0
    assert piece_automaton.piece_codes(empty).count() == 0
    m = piece_automaton.model(piece_automaton.model_path())
    assert all(m.decode(m.encode_text(t or "")) == sp.decode(sp.encode(t or "")) for t in HARD)


def test_long_runs_and_long_parts_equal_the_library():
    import time

    import sentencepiece

    m = piece_automaton.model(piece_automaton.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_automaton.model_path())
    rng = random.Random(1)
    for n in (63, 64, 65, 79, 80, 81, 1000, 5003):
        for t in (" " * n, " " * n + "word", "a" + " " * n + "日本", "word" + " " * n, "\n".join([" " * n] * 2)):
            assert np.frombuffer(m.encode_text(t), "<u4").tolist() == sp.encode(t)
    for _ in range(60):
        t = "".join(rng.choice([" ", "  ", "a", "the", "in", " " * 40]) for _ in range(rng.randint(10, 300)))
        assert np.frombuffer(m.encode_text(t), "<u4").tolist() == sp.encode(t)
    for _ in range(60):  # the heap against the scan
        t = "".join(rng.choice("▁▁▁aetins") for _ in range(rng.randint(2, 64)))
        assert m.merge(t) == m._merge_long(list(t))
    began = time.time()
    for t in (" " * 1_000_000 + "end", "  " + "日本語" * 100_000):
        assert np.frombuffer(m.encode_text(t), "<u4").tolist() == sp.encode(t)
    assert time.time() - began < 20


def test_unigram_scores_are_the_best(spark):
    rng = random.Random(5)
    listed = [("<unk>", 0.0, 2)] + [(p, -rng.random() * 5 - 1, 1) for p in ("▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb")]
    m = piece_automaton.PieceModel.of(listed, bpe=False)
    score = {p: s for p, s, _ in listed}

    def best(t):
        at = [0.0] + [float("-inf")] * len(t)
        for j in range(1, len(t) + 1):
            at[j] = at[j - 1] + m.low
            for i in range(j):
                if t[i:j] in score:
                    at[j] = max(at[j], at[i] + score[t[i:j]])
        return at[-1]

    for _ in range(200):
        t = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        got = sum(m.score[i] if i >= 0 else m.low for i in m.encode(t))
        assert got == pytest.approx(best(t))


# --- fingerprints


def test_multiset_sums_and_edits(docs, hard, empty):
    h = multiset_hash
    a, b, c = h.fingerprint("one paragraph\nand two\nx"), h.fingerprint("x\none paragraph\nand two"), h.fingerprint("one paragraph\nx")
    assert a == b != c and h.combine(c, h.fingerprint("and two")) == a and h.combine(a, h.fingerprint("and two"), -1) == c
    assert len(a) == h.SIZE and h.likeness(a, b) == 1.0 and 0 < h.likeness(a, c) < 1
    for df in (docs, hard):
        order = sorted(texts_of(df), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        wanted = []
        for i, (d, t) in enumerate(order):
            n = order[(i + 1) % len(order)][1]
            k = len(t) // 2
            e = t[: len(t) - k] + n[:k]
            wanted.append((d or -1, len(t), hashlib.sha256(e.encode()).hexdigest(), h.fingerprint(t).hex(), h.fingerprint(e).hex(), round(h.likeness(h.fingerprint(t), h.fingerprint(n)), 9)))
        found = [(r.doc_id or -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_next, 9)) for r in h.document_fingerprints(df).collect()]
        assert sorted(found) == sorted(wanted)
    assert h.document_fingerprints(empty).count() == 0
    lone = h.document_fingerprints(docs.orderBy("doc_id").limit(1)).first()
    assert lone.near_next == 1.0


def test_long_texts_are_hashed_in_steps(monkeypatch):
    t = "paragraph of words\n" * 50 + "y" * 300
    whole = multiset_hash.fingerprint(t)
    monkeypatch.setattr(multiset_hash, "STEP", 64)
    assert multiset_hash.fingerprint(t) == whole


def test_counts_of_long_repetitive_texts_dont_wrap():
    h = multiset_hash
    for a, b in (("a" * 32774, "a" * 32775), ("word " * 32770, "word " * 32760), ("word " * 200_000, "word " * 200_001)):
        assert h.likeness(h.fingerprint(a), h.fingerprint(b)) > 0.99
    x, y = h.fingerprint("word " * 40_000), h.fingerprint("other line")
    assert h.combine(h.combine(x, y), y, -1) == x


def brute_simhash(text, size):
    import re

    ws = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    sh = [b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and comp[j] != comp[i]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_simhash_components_equal_brute_force(spark, docs, hard, empty):
    own = docs.unionByName(hard.where("doc_id is not null").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]))
    fps = {d: brute_simhash(t, 3) for d, t in texts_of(own)}
    comp = brute_components(fps)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(own).collect()}
    assert found == {d: (f"{fps[d]:016x}", comp[d]) for d in fps}
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.simhash_components(hard).count() == hard.count()


def test_dense_neighbourhoods_and_split_shards(spark, monkeypatch):
    rng = random.Random(2)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(60):
            values.add(v)
            v ^= 1 << rng.randrange(64) if rng.random() < 0.8 else 3 << rng.randrange(60)
    values |= {rng.getrandbits(64) for _ in range(100)}
    wanted = brute_components({v: v for v in values})
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    for size in (4000, 7):
        monkeypatch.setattr(simhash, "SHARD", size)
        comp = {r.node: r.component for r in simhash.connected_components(simhash.near_fingerprints(fps)).collect()}
        groups, mine = {}, {}
        for v in values:
            groups.setdefault(wanted[v], set()).add(v)
            mine.setdefault(comp.get(simhash.signed(v), simhash.signed(v)), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_a_crowded_shard(spark, monkeypatch):
    """Values alike in their upper half: keyed anew until shards are small, with no task above the bound."""
    rng = random.Random(11)
    values = {rng.getrandbits(18) << 5 | 7 << 40 for _ in range(6000)}
    monkeypatch.setattr(simhash, "SHARD", 150)
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    held = []
    links = simhash.shard_links

    def seen(shards, *rest):
        held.append(shards.groupBy("key").count().agg({"count": "max", "*": "count"}).first()[0])
        held.append(shards.count())
        return links(shards, *rest)

    monkeypatch.setattr(simhash, "shard_links", seen)
    got = {r.node: r.component for r in simhash.connected_components(simhash.near_fingerprints(fps)).collect()}
    comp = {v: v for v in values}
    root = lambda v: v if comp[v] == v else root(comp[v])
    flips = [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    for v in values:
        for f in flips:
            if v ^ f in comp and (a := root(v)) != (b := root(v ^ f)):
                comp[max(a, b)] = min(a, b)
    groups, mine = {}, {}
    for v in values:
        groups.setdefault(root(v), set()).add(v)
        mine.setdefault(got.get(simhash.signed(v), simhash.signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values())) and len(groups) > 1
    assert held[1] < 60 * len(values)


def test_a_shard_is_never_held_whole(spark, monkeypatch):
    """20,000 rows of one shard: trees stay at the bound, the rest streams past, and links grow with rows."""
    monkeypatch.setattr(simhash, "SHARD", 4000)
    rng = random.Random(12)
    centre = [rng.getrandbits(512) for _ in range(40)]
    rows = []
    for i in range(20_000):
        v = centre[i % 40]
        for _ in range(rng.randrange(4)):
            v ^= 1 << rng.randrange(512)
        rows.append((1, i.to_bytes(4, "big"), v.to_bytes(64, "little")))
    df = spark.createDataFrame(rows, "key long, node binary, value binary").repartition(4)
    links = simhash.shard_links(df, 60, "binary", 30)
    found = simhash.written(links, "t")
    assert found.count() < 8 * len(rows) and found.where("not sure").count() == 0
    sizes = [r["n"] for r in simhash.connected_components(found.select("a", "b")).groupBy("component").agg(simhash.F.count("*").alias("n")).collect()]
    assert sizes == [500] * 40


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows, originals = [], []
    for i in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.choice([40, 200, 600]))]
        rows.append((1000 + i, " ".join(ws)))
        originals.append(1000 + i)
        if i < 30:
            v = list(ws)
            for _ in range(max(1, len(v) // 100)):
                v[rng.randrange(len(v))] = "edit"
            if len(ws) == 40:
                v = [*ws, "added"]
            rows.append((2000 + i, " ".join(v)))
            rows.append((3000 + i, " ".join(ws)))
    rows += [(9000, ""), (9001, None), (1000, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as class_id")
    kept = [r.doc_id for r in simhash.keep_one_of_each(df).collect()]
    assert sorted(kept) == sorted([*originals, 9000])
    assert simhash.keep_one_of_each(df.where("false")).count() == 0


def test_repeats_and_few_words_dont_hide_near_copies():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    pairs = []
    for _ in range(50):
        own, line = (" ".join(rng.choices(vocab, k=n)) for n in (100, 10))
        pairs += [(f"{own} {line} {line}", " ".join([own, *[line] * n])) for n in (10, 20)]
    for n in (1, 3, 8, 9, 12, 40):
        for _ in range(50):
            few = rng.choices(vocab, k=n)
            pairs.append((" ".join(few), " ".join([*few, "more"])))
    sure, radius = simhash.radii(0.8)
    found = 0
    for a, b in pairs:
        x, y = (simhash.shingle_set(t, 5) for t in (a, b))
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            found += 1
            u, v = (int.from_bytes(simhash.wide_simhash(s), "little") for s in (x, y))
            assert (u ^ v).bit_count() <= radius
    assert found >= 300 and sure < 60


def test_classes_equal_brute_force_without_common_pieces(spark, monkeypatch):
    """Lone pairs on one template, edited so that they share few stretches, and short texts with a word more."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(2000)]
    line = rng.choices(vocab, k=30)
    rows = []
    for i in range(150):
        ws = [*line, *rng.choices(vocab, k=rng.choice([3, 8, 50, 90]))]
        if i % 3 == 0:
            ws = ws[30:]
        v = list(ws)
        for at in range(len(v) // 2, len(v), 45):
            v[at] = "edit"
        rows += [(1000 + i, " ".join(ws)), (2000 + i, " ".join(v)), (3000 + i, " ".join([*ws, "more"]))]
    sets = {d: set(simhash.shingle_set(t, 5).tolist()) for d, t in rows}
    comp = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (50_000, 0):
        monkeypatch.setattr(simhash, "COMMON", common)
        assert {r.doc_id: r.class_id for r in simhash.similar_documents(df).collect()} == comp


# --- lines


def brute_lines(rows, least):
    """Lines of any later copy of a common run: runs grow line by line from every pair of equal lines, without windows.

    In one text the copy ends where it would meet the first place.
    """
    seqs = []
    for d, t in rows:
        lines = [" ".join(x.split()) for x in t.split("\n") if x.split()]
        seqs.append(((-(2**63) if d is None else d, winnow.signed(xxhash.xxh3_64_intdigest(t))), lines))
    gone = {}
    for s, (late, x) in enumerate(seqs):
        for early, y in seqs:
            if early > late:
                continue
            for i in range(len(x)):
                for j in range(len(y) if early < late else i):
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and (early < late or j + n < i):
                        n += 1
                    if sum(len(z.split()) for z in x[i : i + n]) >= least:
                        gone.setdefault(s, set()).update(range(i, i + n))
    return [sorted(gone.get(s, ())) for s in range(len(seqs))]


def test_winnowing_equals_brute_force(spark, docs, hard, empty):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(14)]
    rows = [(i if i else None, "\n".join([rng.choice([*pool, "", f"own {i} {k}"]) for k in range(rng.randint(0, 14))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_lines(rows, 12)
    kept = [[x for i, x in enumerate([x for x in t.split("\n") if x.split()]) if i not in set(g)] for (_, t), g in zip(rows, gone, strict=True)]
    wanted = sorted(((d or -1), len(g), k) for (d, _), g, k in zip(rows, gone, kept, strict=True))
    found = sorted((r.doc_id or -1, r.removed_lines, [x for x in r.text.split("\n") if x.split()]) for r in winnow.delete_repeated_lines(df, 12).collect())
    assert found == wanted and sum(n for _, n, _ in wanted) > 20
    base = {d: t for d, t in texts_of(docs)}
    out = winnow.delete_repeated_lines(docs).collect()
    assert len(out) == len(base) and all(r.text == base[r.doc_id] for r in out if not r.removed_lines)
    assert all(r.n_chars == len(r.text) for r in out if r.removed_lines)
    assert winnow.delete_repeated_lines(hard).count() == hard.count() and winnow.delete_repeated_lines(empty).count() == 0
    assert winnow.delete_repeated_lines(hard).columns[:6] == hard.columns


def test_runs_that_overlap_themselves(spark):
    equal = "\n".join(["one"] * 40)
    rows = [(1, equal), (2, "\n".join(["a b", "c"] * 9)), (3, "\n".join(["x"] * 7)), (4, "\n".join(["y"] * 10))]
    out = {r.doc_id: (r.text, r.removed_lines) for r in winnow.delete_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert out[1] == ("\n".join(["one"] * 5), 35) and out[3] == (rows[2][1], 0) and out[4] == ("\n".join(["y"] * 5), 5)
    for (d, t), g in zip(rows, brute_lines(rows, 5), strict=True):
        assert out[d] == ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in g), len(g))


def test_only_selected_positions_leave_the_texts(docs):
    rows = winnow.selected_rows(docs, 50)
    wanted = {}
    for d, t in texts_of(docs):
        lines = [" ".join(x.split()) for x in t.split("\n") if x.split()]
        hs, ws = [xxhash.xxh3_64_intdigest(x) for x in lines], [len(x.split()) for x in lines]
        for i in range(len(hs)):  # every window selects one of these
            j = next((j for j in range(i, len(hs)) if sum(ws[i : j + 1]) >= 50), None)
            if j is not None:
                wanted.setdefault(d, set()).add(max(p for p in range(i, j + 1) if hs[p] == min(hs[i : j + 1])))
    found = {}
    for r in rows.collect():
        found.setdefault(r["_doc"], []).append(r["at"])
        assert len(r["lines"]) == len(r["sizes"]) and r["lines"][r["at"] - r["lo"]] == r["print"]
    assert all(len(v) == len(set(v)) and wanted.get(d, set()) <= set(v) for d, v in found.items()) and wanted.keys() <= found.keys()


def test_clashing_names_and_one_very_long_text(spark):
    long = "\n".join(f"line {i % 5000} of a very long text with words" for i in range(200_000))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3), (None, None, None, 2, 3)], "doc_id long, text string, _ver int, _spans int, row int")
    out = {r.doc_id: r for r in winnow.delete_repeated_lines(df).collect()}
    assert out[1].removed_lines == 195_000 and out[2].text == "" and out[None].text is None
    assert (out[2]["_ver"], out[2]["_spans"], out[2]["row"]) == (1, 2, 3)


def test_hot_passages_keep_one_place(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SHARE", 10)
    monkeypatch.setattr(winnow, "MOST_HOT", 1)
    passage = " ".join(f"p{i}" for i in range(55))
    df = spark.createDataFrame([(i, f"start {i}\n{passage}\nend {i}") for i in range(300)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in winnow.delete_repeated_lines(df).collect()}
    assert passage in out[0] and all(out[i] == f"start {i}\nend {i}" for i in range(1, 300))


# --- nearest neighbours


def test_neighbours(spark, sf):
    v = table(spark, sf, "embeddings")
    found = postings.nearest(v)
    assert postings.recall(found, v) >= 0.95
    x = {r.vec_id: np.array(r.embedding, "f8") for r in v.collect()}
    for r in found.collect():
        a, b = x[r.query_id], x[r.vec_id]
        assert r.score == pytest.approx(float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), abs=1e-12) and r.query_id % 50 == 0 and r.query_id != r.vec_id


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(0, 200)] + [(1000, [0.0, 0.0, 0.0]), (1050, None), (1100, [1.0, None, 2.0]), (1150, [1.0, nan, 0.0]), (1200, [inf, 0.0, 1.0]), (1250, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in postings.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 50, 100, 150]
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and sorted(got[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert postings.nearest(df.where("false")).count() == 0
    assert postings.nearest(df.where("vec_id = 50")).count() == 0


def test_far_queries_still_get_five(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * 0.01 + 10 * np.eye(8)[(i // 3) % 8] * (1 if i % 2 else -1)).tolist()) for i in range(600)] + [(50_000, [0.1, -9.0, 3.0, 0.5, -4.0, 2.0, 7.0, -1.0])]
    found = postings.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lists=60).groupBy("query_id").count().collect()
    assert len(found) == 13 and all(r["count"] == 5 for r in found)


def test_large_lists_are_cut_and_queries_come_in_blocks(spark, sf, monkeypatch):
    v = table(spark, sf, "embeddings")
    wanted = sorted(map(tuple, postings.nearest(v, lists=20).collect()))
    monkeypatch.setattr(postings, "SHARD_ROWS", 20)
    monkeypatch.setattr(postings, "QUERY_ROWS", 4)
    assert sorted(map(tuple, postings.nearest(v, lists=20).collect())) == wanted


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_many_lists_are_pruned(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        x = rng.normal(size=(150, 32))[rng.integers(0, 150, 20_000)] + 0.25 * rng.normal(size=(20_000, 32))
    else:
        x = rng.normal(size=(20_000, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    found = postings.written(postings.nearest(df, report=report), "t")
    assert report["lists"] >= 200 and postings.recall(found, df) >= 0.9
    assert report["share"] <= (0.1 if kind == "clustered" else 0.45)


def test_extreme_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 10.0 ** (300 if i % 3 == 0 else -310 if i % 3 == 1 else 0)).tolist(), "x", 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, list int")
    x = {i: np.array([float(c) * 2.0**-990 if abs(c) > 1e100 else float(c) * 2.0**1000 if abs(c) < 1e-100 else c for c in v]) for i, v, *_ in rows}
    got = {}
    for r in postings.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 50, 100]
    for q, found in got.items():
        cos = {i: float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))) for i, v in x.items() if i != q}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        assert [i for _, i, _ in sorted(found)] == best and all(s == pytest.approx(cos[i], abs=1e-9) for _, i, s in found)


# --- pages

ARTICLE = "First paragraph of the story, long enough to count as text.", "Second one &amp; more,\n  with   white space.", "Short."


def page(body):
    return f"<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        "<nav><ul><li><a href=/>Home</a></li></ul></nav><article>{}</article><footer>&copy; x</footer>",
        "<div class='menu'><a>x</a></div><div id=content><div>{}</div></div><div class='sidebar'><p>Related stories and things to read next.</p></div><div class='comments'><p>Great post, I liked it very much indeed!</p></div>",
        "<header><h2>Site</h2></header><main>{}<aside>Ad text here</aside></main><form><p>Sign up now please</p></form>",
        "<div class='post has-comments layout-with-sidebar'>{}<section id='comments'><p>First! And a long remark on all of it.</p></section></div>",
        "<div class='cookie-notice'><p>We use cookies on this site to make it better.</p></div>{}<footer><p>Terms</p></footer>",
    ],
)
def test_articles(body):
    inner = "".join(f"<p>{p}" if i % 2 else f"<p>{p}</p>" for i, p in enumerate(ARTICLE))
    wanted = "First paragraph of the story, long enough to count as text.\n\nSecond one & more, with white space.\n\nShort."
    assert main_text.main_text(page(body.format(inner))) == wanted


LONG = [f"Paragraph {i} of the story tells at some length what came before and after it, in words that no menu would have." for i in range(4)]


@pytest.mark.parametrize(
    "body",
    [  # no semantic tags, no telling names: the ratios decide
        "<div><div><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>Sport</a></div><div>Today only: ten per cent off</div><div>{}</div><div><a href=/i>Imprint</a> <a href=/t>Terms</a><br>One line of rights</div></div>",
        "<div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div><div><div><div>{}</div></div></div><div><p>Small print</p></div>",
        "<table><tr><td><a>Home</a><br><a>Away</a></td></tr></table><div>{}</div><div><b>Read</b> <b>more</b> <i>here</i></div><table><tr><td>Rights <a>x</a></td></tr></table>",
    ],
)
def test_ratios_decide_without_telling_tags(body):
    inner = "<h2>The story</h2>" + "".join(f"<p>{p}</p>" for p in LONG)
    html = page(body.format(inner))
    assert main_text.main_text(html) == "\n\n".join(["The story", *LONG])
    assert main_text.main_text(html, share=0.0, nearly=1.0) != main_text.main_text(html)  # without a threshold more stays
    # names that would tell against the long block are believed, and what is left is clustered anew
    assert all(p not in main_text.main_text(page(f"<div class=comments>{inner}</div><div><p>{ARTICLE[0]}</p></div>")) for p in LONG)


def test_deep_nesting(spark):
    deep = "<div>" * 100_000 + "<p>A paragraph far down.</p>" + "</section>" * 1000 + "</div>" * 100_000
    assert main_text.main_text(deep) == "A paragraph far down."
    rows = spark.createDataFrame([(1, "u", deep), (1, "u", deep), (2, "u", "<b>" * 5000 + "x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in main_text.page_texts(rows).collect()) == [(1, "A paragraph far down.")] * 2 + [(2, "x")]


def test_page_tables(spark, sf):
    p = table(spark, sf, "pages")
    out = main_text.page_texts(p).collect()
    assert len(out) == p.count() and all(r.text and r.n_chars == len(r.text) for r in out)
    for r in p.collect():  # the template's article, cut out by hand
        import html
        import re

        inner = r.html[r.html.index("<article>") + 9 : r.html.rindex("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert next(o.text for o in out if o.page_id == r.page_id) == "\n\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p>plain"), (5, "u", "<div><p>a</div></div></p>b")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.page_texts(odd).collect()}
    assert got[1] == got[2] == "" and got[4] == "plain"
    assert main_text.page_texts(odd.where("false")).count() == 0


# --- models


def test_toxicity_on_held_out_rows(spark, hard, empty):
    big = "/root/testdata/sf0.01"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_rows(docs, model).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc >= 0.9
    flagged = [r for r in rows if r.predicted]
    assert flagged and np.mean([r.toxic for r in flagged]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = toxicity.toxicity_scores(hard, model)
    assert out.count() == hard.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_rows(empty, model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert toxicity.score_rows(docs.limit(3), none).count() == 3


def test_a_null_id_leaves_others_held_out(spark):
    model = toxicity.ToxicityModel().fit({}, np.zeros((0, len(toxicity.NAMES))), np.zeros(0))
    ids = [None, *range(2**53 - 3, 2**53 + 9), 0, -4]
    df = spark.createDataFrame([(i, "some text", 9.0) for i in ids], "doc_id long, text string, score double").coalesce(1)
    wanted = {i: zlib.crc32(str("" if i is None else i).encode()) % 3 == 1 for i in ids}
    assert {r.doc_id: r.held_out for r in toxicity.toxicity_scores(df, model).collect()} == wanted
    assert {r.doc_id: r.held_out for r in toxicity.score_rows(df, model).collect()} == wanted and not wanted[None]


def test_the_fit_reads_whole_texts(spark):
    rng = random.Random(3)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join([*rng.choices(vocab, k=1200), *(["zorgle", "you", "grubnik"] * 5 if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(300)]
    assert min(t.find("zorgle") for _, t, y in rows if y) > 6000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert {"zorgle", "grubnik"} <= model.lexicon.keys()
    found = {r.doc_id: r.predicted for r in toxicity.score_rows(docs, model).where("held_out").collect()}
    assert found and all(p == int(d % 3 == 0) for d, p in found.items())


def test_isotonic_and_trees():
    x = np.arange(40.0)
    y = (x > 20).astype(float)
    y[5], y[30] = 1, 0
    f = toxicity.Isotonic().fit(x, y).apply(x)
    assert (np.diff(f) >= 0).all() and f[0] < 0.3 < 0.7 < f[-1]
    rng = np.random.default_rng(0)
    z = rng.normal(size=(600, 3))
    t = ((z[:, 0] > 0) ^ (z[:, 1] > 0)).astype(float)
    p = toxicity.Boosted().fit(z, t).raw(z)
    assert ((p > 0) == (t > 0)).mean() > 0.95


def coordinate_descent(p, t, want, have, floor, sweeps=1500):
    """Nonnegative least squares one rate at a time, each set to its own minimum: another way to the objective's least value."""
    r = np.full(len(p), max(1.0, floor))
    w = np.where(want > 0, 1 / have, 0)
    got = (r * t) @ p
    for _ in range(sweeps):
        for i in range(len(p)):
            g, h = t[i] * (w * (got - want) * p[i]).sum(), t[i] ** 2 * (w * p[i] ** 2).sum()
            new = max(floor, r[i] - g / h)
            got += (new - r[i]) * t[i] * p[i]
            r[i] = new
    return 0.5 * (w * (got - want) ** 2).sum()


def test_rates_are_least_squares(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.3, 0.2], 40)
    t = rng.integers(1, 500, 40)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "tokens long, p array<double>").coalesce(1)
    have = t @ p
    for targets, floor, budget in (([0.2, 0.5, 0.3], 0.0, None), ([0.1, 0.3, 0.6], 0.0, None), ([0.05, 0.05, 0.9], 0.8, have.sum()), ([1.0, 0.0, 0.0], 1.0, 0.5 * have[0])):
        rates, report = mixing.fit_rates(rows, np.array(targets), budget, floor, rounds=90, tolerance=1e-6)
        want = np.array(targets) * (budget or have.sum())
        r = rates.of(p)
        got = (r * t) @ p
        aimed = want > 0
        worth = 0.5 * ((got - want)[aimed] ** 2 / have[aimed]).sum()
        least = coordinate_descent(p, t.astype("f8"), want, have, floor)
        assert (r >= floor).all() and worth <= least * 1.02 + 1e-6 * have.sum()
        assert report["miss"] == pytest.approx(np.abs((got - want)[aimed] / want[aimed]).max(), rel=1e-6) and report["met"] == (report["miss"] <= 1e-6)


def test_missed_targets_are_said(spark, docs, sf):
    labels = table(spark, sf, "labels")
    with pytest.warns(UserWarning, match="targets missed"):
        out = mixing.mix(docs, labels, {"clean": 0.99, "low": 0.005, "toxic": 0.005}, floor=0.9, budget=1000.0)
    assert out.first().target_miss > 1
    with pytest.raises(ValueError, match="targets missed"):
        mixing.mix(docs, labels, {"clean": 1.0}, floor=0.9, budget=10.0, strict=True)


def test_domains_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    model = mixing.fit_domains(docs, labels.where("doc_id % 3 <> 1"))
    said = {r.doc_id: int(np.argmax(r.p)) for r in mixing.posteriors(docs, model).collect()}
    held = [(mixing.domain_label(r.quality, r.toxic), said[r.doc_id]) for r in labels.where("doc_id % 3 = 1").collect()]
    assert np.mean([a == b for a, b in held]) >= 0.9
    assert np.mean([b == 2 for a, b in held if a == 2]) >= 0.6


def test_mixture_meets_its_targets(spark, docs, hard, empty, sf):
    labels = table(spark, sf, "labels")
    model = mixing.fit_domains(docs, labels)
    rows = mixing.written(mixing.posteriors(docs, model), "t")
    p = np.array([r.p for r in rows.collect()])
    assert np.allclose(p.sum(1), 1)
    for targets, floor in (([0.7, 0.2, 0.1], 0.0), ([0.2, 0.6, 0.2], 0.0), ([0.5, 0.5, 0.0], 1.0)):
        rates, report = mixing.fit_rates(rows, np.array(targets), floor=floor)
        got = np.zeros(3)
        for r in rows.collect():
            got += rates.of(np.array([r.p]))[0] * r.tokens * np.array(r.p)
        aimed = np.array(targets) > 0
        want = np.array(targets) / sum(targets) * sum(report["wanted"])
        assert np.allclose(got[aimed], want[aimed], rtol=0.02) or floor > 0
        assert (rates.of(p) >= floor - 1e-12).all()
    once = mixing.repeat_rows(docs.withColumn("row", docs.doc_id).withColumn("copies", docs.doc_id), labels, {"clean": 0.9, "low": 0.1})
    assert once.columns == [*docs.columns, "row", "copies"] and once.where("row <> doc_id or copies <> doc_id").count() == 0
    once = once.select(docs.columns)
    assert {r.doc_id for r in once.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} and once.columns == docs.columns
    assert mixing.mix(hard, labels, {"clean": 1.0}, model=model).count() == hard.count()
    assert mixing.mix(empty, labels, {"clean": 1.0}, model=model).count() == 0


def test_wide_fingerprints_count_bits_by_rows():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 14, 15, 16, 255, simhash.AT_ONCE, 2 * simhash.AT_ONCE + 1):
        h = rng.integers(0, 2**63, n, dtype="u8") * np.uint64(2) + np.uint64(n % 2)
        rows = simhash.remixed(h)
        assert rows.shape == (1 + len(simhash.MIXERS), n)
        want = np.array([[int(((r >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(64)] for r in rows])
        assert (simhash.row_bit_counts(rows) == want).all()
        assert simhash.wide_simhash(h) == np.packbits(2 * want.reshape(-1) > n, bitorder="little").tobytes()


def test_shingle_sets_tell_order_and_fold_repeats():
    def one(t):
        return simhash.shingle_set(t, 5).tolist()

    assert one("") == one(" \n") == []
    assert len(one("a b")) == 1 and one("a b") == one("A\tb") != one("b a")
    assert len(one("a b c d e f")) == 2 and len({*one("a b c d e"), *one("b a c d e"), *one("a b c e d")}) == 3
    assert len(one("x " * 50)) == 1


def test_words_that_differ_in_marks_are_encoded_once():
    import sentencepiece

    m = piece_automaton.PieceModel(piece_automaton.model_path())
    known = sentencepiece.SentencePieceProcessor(model_file=piece_automaton.model_path())
    seen, encode = [], m.encode
    m.encode = lambda part: seen.append(part) or encode(part)
    texts = ["wordlikething", "wordlikething.", "wordlikething,\nNext", "wordlikething$$$", "\nNext wordlikething.\n", "Ñueco.\nétñ \u2581x.y ...a()."]
    for t in texts:
        assert np.frombuffer(m.encode_text(t), "<u4").tolist() == known.encode(t), t
    assert sum("wordlikething" in p for p in seen) == 1


def test_pieces_of_a_batch_are_looked_up_once_and_placed_in_order():
    path = bpe_count.tokenizer_path()
    library = bpe_count.load(path)
    texts = [t or "" for t in HARD] + ["word word. word, Straße\nnext word$$$  x", "a  b \n c", " led and ended ", "word", "Straße word. word"] * 3
    encode = bpe_count.piece_encoder(path, 5)
    for limit in (5, 1000):
        asked = []
        memo = bpe_count.Memo(lambda keys, lead: asked.extend((lead, k) for k in keys) or encode(keys, lead), limit)
        for _ in range(2):
            for t, ids in zip(texts, memo.joined(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
        if limit == 1000:
            assert len(asked) == len(set(asked))
    assert memo.joined([]) == []
