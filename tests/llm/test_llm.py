"""The ten operators against brute force, exact round trips or held-out accuracy; and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.llm import chat, components, langid, mixing, pieces, queries, rules, simhash, spotsigs, tokencount, tokenfile, toxicity

FOLDER = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, h long, copy int, fp long, range int, root long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, "a b c d " * 3000), (7, "a b c d " * 3000), (7, "a b c d " * 3000), (8, "x" * 20000), (None, "no id here"), (9, "▁<s> [INST] 漢字 \\ <|"), (9, "another text of nine")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, ties, repeated rows, and further columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, 5, 6) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def joined(rows):
    """doc_id lists of equal or linked fingerprints -> component by brute force over all pairs."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return [(i, "%016x" % f, least.get(top(f))) for i, f in rows]


def test_simhash_brute_force(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted(joined(rows))


def test_simhash_odd(odd):
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=repr)
    assert got == sorted(joined([(i, plain_fingerprint(t)) for i, t in ODD]), key=repr)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [2, 4096])
def test_trie_links_dense_fingerprints(spark, crowded):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 4))) for c in centres for _ in range(60)} | {rnd.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(0, f - (1 << 64) if f >> 63 else f) for f in fps], "table int, fp long")
    links = simhash.near_links(df, crowded=crowded)
    roots = {r.node % (1 << 64): r.root for r in components.connected_components(links).collect()}
    mine = {}
    for i, f in enumerate(fps):
        mine.setdefault(roots.get(f, f), []).append(f)
    want = {}
    for i, _, c in joined(list(enumerate(fps))):
        want.setdefault(c, []).append(fps[i])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    pairs = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.near_links(df, crowded=crowded, pairs=True).collect()}
    assert all((min(p) ^ max(p)).bit_count() <= 3 for p in pairs)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


def test_near_copies_are_dropped(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(220)] for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        rows.append((100 * k, " ".join(b)))
        rows.append((100 * k + 1, " ".join(b)))
        for j in range(2, 5):
            c = list(b)
            for p in rnd.sample(range(10, 210), 3):
                c[p] = word()
            rows.append((100 * k + j, " ".join(c)))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {100 * k for k in range(12)} <= kept and len(kept) <= 15


def least_of_near_copies(rows, words=5, similarity=0.8):
    """The least id of every group of (id, text) rows that pairs of alike sets of word runs join, by all pairs."""
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()))
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if 10 * len(x & y) >= round(10 * similarity) * len(x | y):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {top(i) for i, _ in rows}


def kept_of(spark, rows):
    return {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def made_up(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_pairs_of_dense_fingerprints_are_all_found(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 3))) for _ in range(150)})
    df = spark.createDataFrame([(0, f - (1 << 64) if f >> 63 else f) for f in fps], "table int, fp long")
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.near_links(df, pairs=True).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 3}


@pytest.mark.parametrize("most", [1, 5, 1 << 16])
def test_trie_walk_with_few_node_pairs_at_a_time(most):
    rnd = random.Random(8)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rnd.sample(range(48), rnd.randrange(0, 3))) for _ in range(200)} | {rnd.getrandbits(64) for _ in range(100)})
    keys = np.array(fps, np.uint64)
    got = [(int(a), int(b)) for i, j in simhash.trie_pairs(keys, np.array([0, len(keys)]), 0, 3, most) for a, b in zip(i, j)]
    want = {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3}
    assert len(got) == len(want) and set(got) == want
    none = np.zeros(0, np.uint64)
    assert not list(simhash.trie_pairs(none, np.array([0, 0]), 0, 3))


def test_subtree_links_are_a_forest_however_few_are_held(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 0)
    rnd = random.Random(9)
    fps = sorted({sum(1 << b for b in rnd.sample(range(48), rnd.randrange(0, 3))) for _ in range(150)})
    rows = pd.DataFrame({"turn": np.zeros(len(fps), np.int32), "path": (np.array(fps, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)})
    links = pd.concat(list(simhash._subtree_links(3, 0, False)(iter([rows]))))
    assert len(links) == len(fps) - 1 and set(links["b"]) == {0}


def test_dense_groups_with_texts_apart(spark, monkeypatch):
    """Texts of a dense shingle that the largest part doesn't join meet each other and all of its blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 12)
    rnd = random.Random(31)
    base, rows = made_up(rnd, 100), []
    for k in range(70):
        c = list(base)
        for p in rnd.sample(range(100), 1 if k < 50 else 3):
            c[p] = made_up(rnd, 1)[0]
        rows.append((k, " ".join(c)))
    for g in range(2):  # far from the first, near each other
        far = base[:80] + made_up(rnd, 25)
        rows += [(100 * (g + 1) + k, " ".join(far[: 100 + k])) for k in range(5)]
    want = least_of_near_copies(rows)
    assert 2 < len(want) < 40
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), few=1, each_text=0)
    assert {r.doc_id for r in got.collect()} == want


def test_near_copies_in_a_dense_neighbourhood(spark):
    rnd = random.Random(11)
    base, rows = made_up(rnd, 120), []
    for k in range(60):  # neighbours of neighbours: each text changes the one before or the first
        c = list(base) if k % 3 else (rows[-1][1].split() if rows else list(base))
        for p in rnd.sample(range(120), 2):
            c[p] = made_up(rnd, 1)[0]
        rows.append((k, " ".join(c)))
    assert kept_of(spark, rows) == least_of_near_copies(rows)


def test_near_copies_beside_other_orders_of_their_words(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(6):
        base = made_up(rnd, 200)
        for j in range(8):  # eight orders of the same words, each with a near copy of the same words
            c = rnd.sample(base, 200)
            rows.append((100 * k + 2 * j, " ".join(c)))
            c[50], c[51] = c[51], c[50]
            rows.append((100 * k + 2 * j + 1, " ".join(c)))
    want = least_of_near_copies(rows)
    assert len(want) == 48 and kept_of(spark, rows) == want


def test_near_copies_with_a_passage_more_or_other(spark):
    rnd = random.Random(13)
    rows = []
    for k in range(20):
        base = made_up(rnd, 204)
        at = rnd.randrange(204)
        for j, c in enumerate((base, base + made_up(rnd, 50), base[:at] + made_up(rnd, 40) + base[at:], base[:184] + made_up(rnd, 20), base[38:], base + made_up(rnd, 60))):
            rows.append((10 * k + j, " ".join(c)))
    want = least_of_near_copies(rows)
    assert 20 <= len(want) <= 40 and kept_of(spark, rows) == want


def test_near_copies_of_the_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert kept_of(spark, rows) == least_of_near_copies(rows)


def test_drop_near_copies_odd(odd):
    got = simhash.drop_near_copies(odd)
    assert got.columns == odd.columns
    assert sorted(got.select("doc_id").collect(), key=repr) == sorted([(i,) for i in (1, 4, 5, 6, 8, None, 9, 9)], key=lambda r: repr(Row(doc_id=r[0])))


def test_spotsigs_edit_probe(docs):
    got = {r.doc_id: r for r in spotsigs.edit_probe(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, n = texts[k], texts[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_next <= 1 and 0 <= got[k].near_edited <= 1
    names = {}
    for k, t in texts.items():
        assert names.setdefault(t, got[k].fingerprint) == got[k].fingerprint
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_spotsigs_chain(spark):
    row = spark.createDataFrame([("The quick, brown fox of the old town",), ("no anchors here? none",), ("...",), ("",), (None,)], "t string")
    sizes = [len(r.s) for r in spotsigs.signatures(row, "t", "s").collect()]
    assert sizes[0] == 2 and sizes[2:] == [1, 0, 0]


def test_spotsigs_odd(odd):
    got = spotsigs.edit_probe(odd).collect()
    assert len(got) == len(ODD)
    same = {r.fingerprint for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert spotsigs.edit_probe(odd.limit(0)).count() == 0
    alone = spotsigs.edit_probe(odd.where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_spotsigs_pairs_brute_force(docs):
    some = spotsigs.signatures(docs.select("doc_id", "text"), "text", "s").collect()
    reps = {}
    for r in sorted(some):
        if r.s:
            reps.setdefault(tuple(r.s), r.doc_id)
    want = {}
    for (a, i), (b, j) in itertools.combinations(reps.items(), 2):
        v = len(set(a) & set(b)) / len(set(a) | set(b))
        if v >= 0.6:
            want[min(i, j), max(i, j)] = round(v, 9)
    assert {(r.a, r.b): round(r.likeness, 9) for r in spotsigs.near_duplicates(docs, 0.6).collect()} == want


def test_language(docs, odd):
    langs, probs = langid.fit(docs, PIECES, per_language=40, rounds=2)
    got = langid.predict(docs, langs, probs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd_got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, langs, probs, PIECES).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= odd_got
    none = langid.identify(odd, PIECES).collect()  # no lang to learn from
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}


def test_forward_sums_all_segmentations():
    vocab = {"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "▁ab": 5}
    p = np.random.default_rng(1).random((6, 2))
    lattice = langid.spans(["▁abab", "▁bbab"], vocab, 3)
    got = np.exp(langid.log_sums(lattice, 2, p, 1e-9, 3))

    def total(w):
        if not w:
            return np.ones(2)
        return sum(p[vocab[w[:k]]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in vocab)

    assert np.allclose(got[0], total("▁abab")) and np.allclose(got[1], total("▁bbab"))


@pytest.mark.parametrize("path", [PIECES, BYTES, public_tokenizers.path("word_bpe_49k.json")])
def test_token_counts(path, docs, odd):
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for df in (docs, odd):
        texts = [r.text or "" for r in df.select("text").collect()]
        got = tokencount.token_counts(df, path).collect()
        assert [(r.n_tokens, r.n_bytes) for r in got] == [(count(t), len(t.encode())) for t in texts]
    rnd = random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "▁", "a", "the", "é", "漢", "　", "\t", "\r", "<s>", "</s>", "ﬁ", "😀", "1", "...", "\x00", "hello", "<|endoftext|>", "'s"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12))) for _ in range(800)]
    assert tokencount.counter(path).counts(texts) == [count(t) for t in texts]


def test_rule_statistics(docs, odd):
    for df in (docs, odd):
        for r, s in zip(df.select("doc_id", "text").collect(), rules.statistics(df).collect()):
            text = r.text or ""
            words = WORD.findall(text)
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            seen, often = set(), Counter(windows)
            covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
            dups = 0
            for line in text.split("\n"):
                if WORD.search(line):
                    dups += line in seen
                    seen.add(line)
            want = (r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered))
            assert tuple(s)[:6] == want


def test_decision_list(docs, labels, odd):
    rnd = np.random.default_rng(0)
    x = {"a": rnd.random(3000), "b": rnd.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5)
    learned = rules.learn(x, bad)
    found = np.zeros(3000, bool)
    for r in learned:
        found |= r.covers(x)
    assert (found == bad).mean() > 0.98
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    good = [r for r in labels.collect() if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(got[r.doc_id].kept for r in good) >= 0.97 * len(good)
    edge = rules.judge(odd, labels.limit(0)).collect()
    assert len(edge) == len(ODD) and all(r.kept == (not r.base_failed) for r in edge)
    assert rules.judge(odd.limit(0), labels).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "x\\<|</s>"), (1, 0, "user", None), (1, 2, "user", "tail [/INST]\n"), (2, 0, "system", ""), (None, 0, "assistant", "a"), (None, 1, None, "b"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r"), (3, 1, "<|user|>\n", "|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    ex = chat.examples(chat.with_probe(df.select("conv_id", "turn", "role", "text")))
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    convs = {}
    for c, t, role, text in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r.loss_start is not None for r in ex.collect()) == 1 + sum(r == "assistant" for _, _, r, _ in rows)
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_segments_by_definition():
    def brute(s):
        best = None
        for i in range(len(s)):
            total = 0
            for j in range(i, len(s)):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        return [] if best is None else brute(s[: best[1]]) + [best[1:]] + [(a + best[2], b + best[2]) for a, b in brute(s[best[2] :])]

    rnd = random.Random(3)
    for _ in range(500):
        n = rnd.randrange(0, 20)
        places = sorted(rnd.sample(range(n), rnd.randrange(0, n + 1)))
        scores, drift = [rnd.uniform(0.01, 2) for _ in places], rnd.choice([0.2, 0.7, 1.3])
        line = [-drift] * n
        for p, v in zip(places, scores):
            line[p] = v
        assert [(s.start, s.end) for s in toxicity.maximal_segments(places, scores, drift)] == brute(line)


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.predict(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).collect() if r.held_out]
    toxic, clean = [r for r in held if known[r.doc_id]], [r for r in held if not known[r.doc_id]]
    assert sum(r.predicted for r in toxic) > 0.7 * len(toxic) and sum(r.predicted for r in clean) < 0.02 * len(clean)
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in toxicity.predict(odd, model).collect())
    assert {r.score for r in toxicity.detect(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_later_toxic_passages_count_in_full():
    model = toxicity.Model({"vile": 3.0, "foul": 3.0, "nasty": 3.0}, rate=2.0)
    scores, plain = toxicity.WordScores(model.weights), ["calm"] * 100
    ws = ["vile", *plain, "foul", *plain, "nasty", *plain, "vile", "foul", "nasty", *plain, "foul", "nasty", "vile"]
    found = [(s.start, s.end, s.score) for s in model.segments(ws, scores)]
    assert found == [(0, 1, 3.0), (101, 102, 3.0), (202, 203, 3.0), (303, 306, pytest.approx(9.0)), (406, 409, pytest.approx(9.0))]


def test_nbest_is_exact():
    at = pieces.lattice(PIECES)
    rnd = random.Random(2)
    for _ in range(120):
        w = "▁" + "".join(rnd.choice("thenigaoré漢") for _ in range(rnd.randrange(0, 8)))
        _, edges = at.forward(w)

        def all_paths(end):
            if not end:
                yield 0.0
            for start, score, _ in edges[end]:
                for x in all_paths(start):
                    yield x + score

        assert np.allclose([s for s, _ in at.nbest(w, 4)], sorted(all_paths(len(w)), reverse=True)[:4])


def test_piece_round_trip(docs, odd):
    rnd = random.Random(6)
    at = pieces.lattice(PIECES)
    parts = [" ", "  ", "\n", "▁", "a", "the", "é", "漢", "\t", "<s>", "ﬁ", "😀", "\x00", "hello"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 9))) for _ in range(400)]
    for t, (ids, n, scores) in zip(texts, at.encode(texts, 3)):
        each = [at._word(w, 3) for w in at.split(t)]
        assert at.decode(np.frombuffer(ids, "<u4")) == t and n == len(ids) // 4
        if len(each) < 7:
            sums = sorted(sum(c) for c in itertools.product(*[(0.0, *e[3]) for e in each]))[:3]
            assert np.allclose(scores, [sum(e[2] for e in each) - x for x in sums])
    for df in (docs, odd):
        enc = pieces.encode_documents(df, PIECES)
        assert all(r.round_trip for r in enc.collect())
        assert sorted((r.text for r in pieces.decode_documents(enc, PIECES).collect())) == sorted(r.text or "" for r in df.collect())


def test_every_one_of_the_n_best_has_its_ids(spark, odd):
    at = pieces.lattice(PIECES)
    score = {i: s for i, s in at.scores.values()}
    rnd = random.Random(8)
    parts = [" ", "\n", "▁", "a", "the", "é", "漢", "hello", "singing", ".", ","]
    texts = ["hello there singing", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 6))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in [*pieces.encode_documents(df, PIECES, nbest=4).collect(), *pieces.encode_documents(odd, PIECES).collect()]:
        every = [r.ids, *r.other_ids]
        assert len(every) == len(r.scores) == len(r.nbest_crc32) == len(set(map(tuple, every)))
        assert r.nbest_crc32 == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in every] and r.nbest_crc32[0] == r.ids_crc32
        assert np.allclose([sum(score.get(x, at.byte_score) for x in i) for i in every], r.scores)
        assert len({at.decode(np.array(i, "i4")) for i in every}) == 1


def test_token_files(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    for df in (docs.repartition(5), odd, odd.limit(0)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = tokenfile.token_files(df, BYTES, str(tmp_path / f"t{len(rows)}")).orderBy("start").collect()
        assert [r.doc_id for r in got] == [i for i, _ in rows]
        start, want = 0, []
        for r in got:
            assert r.start == start
            start += r.n_tokens
        for i, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids + [0]
            want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)


def test_poisson_counts(spark, odd):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise(None).alias("source"))
    rates = {r.source: r.rate for r in mixing.source_rates(df).collect()}
    assert rates["big"] < 1 < rates["mid"]
    n = {r.source: r["count"] for r in mixing.poisson_mix(df).groupBy("source").count().collect()}
    size = {"big": 14000, "mid": 4000, None: 2000}
    for s, k in size.items():
        assert abs(n[s] - rates[s] * k) < 5 * math.sqrt(rates[s] * k)
    many = mixing.poisson_mix(df.where("doc_id < 300").withColumn("source", F.lit("s")), spark.createDataFrame([("s", 900.0)], "source string, rate double"))
    assert abs(many.count() / 300 - 900) < 10
    got = mixing.poisson_mix(odd)
    assert set(odd.columns) | {"order_key"} == set(got.columns) and {r.doc_id for r in got.collect()} <= {i for i, _ in ODD}
    assert mixing.poisson_mix(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    found = c.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    ours = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(r[found.columns.index(x)] for x in columns) for r in found.fetchall()), key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, FOLDER).toPandas(), stage(spark, at, FOLDER).schema)
        sizes.append(at.count())
        if name != "pieces":
            assert at.columns == docs.columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[5]


def test_rules_from_documents_or_statistics(docs, labels):
    assert rules.fit(rules.statistics(docs), labels) == rules.fit_documents(docs, labels)


@pytest.mark.parametrize(("few", "each_text", "block"), [(1, 0, 7), (3, 0, 1024), (2, 100, 1024), (1, 3, 40)])
def test_near_copies_in_blocks(spark, monkeypatch, few, each_text, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # on the driver, where blocks are counted
    rnd = random.Random(21)
    base, rows = made_up(rnd, 100), []
    for k in range(90):
        c = list(base)
        for p in rnd.sample(range(100), rnd.randrange(1, 4)):
            c[p] = made_up(rnd, 1)[0]
        rows.append((k, " ".join(c)))
    shared = " ".join(made_up(rnd, 40))
    rows += [(200 + k, " ".join(made_up(rnd, 30)) + " " + shared) for k in range(30)]
    want = least_of_near_copies(rows)
    assert 30 < len(want) < len(rows)
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), few=few, each_text=each_text)
    assert {r.doc_id for r in got.collect()} == want


def test_overlaps_are_exact(monkeypatch):
    rnd = np.random.default_rng(4)
    x, y = ([np.unique(rnd.integers(0, 200, rnd.integers(0, 60))) for _ in range(n)] for n in (25, 18))
    for cells in (1 << 22, 40):
        monkeypatch.setattr(simhash, "CELLS", cells)
        got = simhash.overlaps(x, y)
        assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(x) for j, b in enumerate(y))


def spot_set(text):
    """Signatures of a text as tuples, without hashes."""
    import regex

    anchors = set(spotsigs.ANCHORS)
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    content = [(p if p in anchors else None, x) for p, x in zip(["", *w], w) if x not in anchors]
    follow = [x for _, x in content[1:]] + [None]
    found = {(a, x, y) for (a, x), y in zip(content, follow) if a}
    return found or {(x, y) for (_, x), y in zip(content, follow)} or ({text} if text else set())


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_spotsigs_probe_brute_force(spark, docs, odd, ranges, monkeypatch):
    whole = spotsigs.with_next
    monkeypatch.setattr(spotsigs, "with_next", lambda d: whole(d, ranges))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), reverse=True)
        got, names = {r.doc_id: r for r in spotsigs.edit_probe(df).collect()}, {}
        assert len(got) == len(rows)
        for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
            cut = len(t) // 3
            e = t[: len(t) - cut] + n[:cut]
            own, edited = spot_set(t), spot_set(e)
            assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_signatures == len(own)
            assert got[i].near_edited == pytest.approx(like(own, edited)) and got[i].near_next == pytest.approx(like(own, spot_set(n)))
            for s, name in ((own, got[i].fingerprint), (edited, got[i].edited_fingerprint)):
                assert names.setdefault(frozenset(s), name) == name
        assert len(set(names.values())) == len(names)


def test_two_language_fits_in_one_session(spark):
    """Fits that differ in a later language only don't share a scorer."""
    vocab = langid.pieces(PIECES)
    df = spark.createDataFrame([(1, "hello there"), (2, "²½ Ⅷ ٣"), (3, "x²")], "doc_id long, text string")
    flat = np.full(len(vocab), 1 / len(vocab))
    for k, want in ((0, "a"), (1, "b")):
        probs = np.array([flat, flat])
        probs[k] *= 1.5
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, ["a", "b"], probs, PIECES).collect()}
        assert got[1][0] == want and got[2] == ("und", 0.0) and got[3][0] == want


def test_long_words_are_summed_whole():
    rnd = np.random.default_rng(5)
    vocab = {"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "bab": 5}
    p = rnd.random((6, 3)) / np.array([40.0, 1e5, 1e9])
    for w in ("▁" + "ab" * 10, "▁" + "abbac" * 40):
        best = [np.zeros(3)]
        for end in range(1, len(w) + 1):
            ways = []
            for k in range(max(0, end - 3), end):
                if w[k:end] in vocab:
                    ways.append(best[k] + np.log(p[vocab[w[k:end]]]))
                elif end - k == 1:
                    ways.append(best[k] + langid.STRANGE)
            best.append(np.logaddexp.reduce(ways))
        got = langid.log_sums(langid.each_span([w], vocab, 3), 1, p, np.exp(langid.STRANGE), 3)[0]
        assert np.allclose(got, best[-1], rtol=1e-9)


def test_quality_verdicts_brute_force(docs, labels):
    learned = rules.fit_documents(docs, labels)
    assert learned
    for r, s in zip(rules.judge(docs, labels).collect(), rules.statistics(docs).collect()):
        assert r.doc_id == s.doc_id
        words, chars = max(s.n_words, 1), max(s.word_chars, 1)
        x = {"words": s.n_words, "word_length": s.word_chars / words, "symbols_a_word": s.n_symbols / words, "dup_lines": s.n_dup_lines / max(s.n_lines, 1), "repeat_words": s.n_repeat_words / words,
             "capitals": s.n_capitals / chars, "marks_a_word": s.n_marks / words, "distinct_words": s.n_distinct / words}
        failed = s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words
        hit = any(all(x[f] <= t if op == "<=" else x[f] > t for f, op, t in rule.tests) for rule in learned)
        assert (r.base_failed, r.kept) == (failed, not failed and not hit)


def plain_segments(line):
    """Maximal segments by definition: the best stretch, then the best ones on either side of it."""
    if not len(line):
        return []
    sums = np.r_[0.0, np.cumsum(line)]
    gains = np.where(np.tri(len(sums), k=-1, dtype=bool), sums[:, None] - sums[None, :], -np.inf)  # end, start
    top = gains.max()
    if top <= 1e-12:
        return []
    ends, starts = np.nonzero(gains >= top - 1e-9)
    a, b = min(zip(starts, ends))
    return [*plain_segments(line[:a]), top, *plain_segments(line[b:])]


def test_toxic_scores_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    some = docs.where("length(text) < 1500").limit(150)
    got = toxicity.predict(some, model).collect()
    for r, text in zip(got, [r.text for r in some.collect()]):
        ws = re.findall(r"[^\W\d_]+", text.lower())
        odds = [max(model.weights.get(f, 0.0) for f in (w, *("^" + w[:n] for n in (4, 5, 6) if len(w) > n))) for w in ws]
        line = np.array([x if x >= model.least and x > 0 else -0.2 for x in odds])
        logs = [model.rate * s - math.log(0.1 * len(ws)) for s in plain_segments(line)]
        z = sum(x for x in logs if x > 0) if any(x > 0 for x in logs) else max([-12.0, *logs])
        want = 1 / (1 + math.exp(-(model.slope * np.sign(z) * np.log1p(abs(z)) + model.shift)))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.7)


def test_segments_take_linear_time():
    n = 200_000
    falling = toxicity.maximal_segments([3 * i for i in range(n)], [0.1] * n)
    assert len(falling) == n
    rising = toxicity.maximal_segments([2 * i for i in range(n)], [1.0] * n)
    assert len(rising) == 1


def test_pieces_of_whole_texts():
    """Fast paths against one lattice over the whole text: every piece as a text, and marks behind what is no letter."""
    at = pieces.lattice(PIECES)

    def best(text):
        _, edges = at.forward("▁" + text.replace(" ", "▁"))
        top = [0.0]
        for row in edges[1:]:
            top.append(max(top[s] + score for s, score, _ in row))
        return top[-1]

    rnd = random.Random(10)
    names = [n.replace("▁", " ") for n in at.scores]
    parts = [*"abzé²½Ⅷ.,;:!?', ", "km²", "the", "9"]
    texts = [*rnd.sample(names, 3000), *names[-500:], *("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(1500)), "a².", "An area of 5 km². So."]
    for t, (_, _, scores) in zip(texts, at.encode(texts, 2)):
        if "▁" not in t and "\n" not in t:
            assert scores[0] == best(t), t


def test_mixing_without_a_broadcast(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("source"))
    whole = sorted(map(tuple, mixing.poisson_mix(df).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(tuple, mixing.poisson_mix(df).collect()), key=repr) == whole


def test_pipeline_brute_force(spark, docs, labels):
    """Each stage of the pipeline against plain Python on its own input."""
    import corpus_pipeline

    stages, rows = dict(corpus_pipeline.STAGES), lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    at = docs
    for name in ("quality", "toxicity", "near_copies"):
        out = stages[name](spark, at, FOLDER)
        have = rows(at)
        if name == "quality":
            kept = {r.doc_id for r in rules.apply(rules.statistics(at), rules.fit_documents(at, labels)).collect() if r.kept}
            want = [r for r in have if r[0] in kept]
        elif name == "toxicity":
            model = toxicity.fit(at, labels)
            want = [r for r in have if model is None or model.score(model.segments(re.findall(r"[^\W\d_]+", r[1].lower()), model.known())) < 0.7]
        else:
            least = least_of_near_copies(have)
            want = [r for r in have if r[0] in least]
        assert rows(out) == want and out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), docs.schema)
    sizes = Counter(r.source for r in at.collect())
    total, roots = sum(sizes.values()), sum(math.sqrt(n) for n in sizes.values())
    want = []
    for r in at.collect():
        rate = math.sqrt(sizes[r.source]) / roots * total / sizes[r.source]
        point = (int(hashlib.md5(f"42|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, below = 0, math.exp(-rate)
        while below <= point:
            k += 1
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        want += [(r.doc_id, r.text)] * k
    mixed = stages["mixing"](spark, at, FOLDER)
    assert rows(mixed) == sorted(want)
    coded = stages["pieces"](spark, mixed, FOLDER).collect()
    lattice = pieces.lattice(PIECES)
    assert sorted((r.doc_id, lattice.decode(np.array(r.ids, "i4"))) for r in coded) == sorted(want)


def test_pipeline_stages_take_odd_rows(spark, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, FOLDER)
        if name != "pieces":
            assert out.columns == corpus_pipeline.COLUMNS
        out.collect()
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
    assert stage(spark, odd, FOLDER).count() == len(ODD)
    kept = corpus_pipeline.quality(spark, odd, FOLDER).collect()
    assert all(r.text is not None and len(r.text.split()) >= 50 for r in kept)
    mixed = corpus_pipeline.mix(spark, odd, FOLDER).collect()
    assert {r.doc_id for r in mixed} <= {i for i, _ in ODD}
