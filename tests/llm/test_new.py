"""Line dedup, prefix trie, resampling and the fit of language models against brute force, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import langid, linededup, prefixtrie, queries, resample

FOLDER = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, h long, k long, d long, v long, pos int, state int, keep binary, place long, _id long, _range int, n long"
CONV_CLASH = "conv_id long, turn long, role string, text string, place long, seq string, node string, path long, h int, donor long, name string"


@pytest.fixture
def many_ranges(spark):
    """As many small ranges as there are partitions: runs of equal hashes lie across their ends."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


# line dedup


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain_dedup(rows, least_docs, least_chars, keep_first):
    docs = {(i, t or "") for i, t in rows}
    found = defaultdict(set)
    for i, t in docs:
        for pos, line in enumerate(t.split("\n")):
            found[line_key(line)].add((-math.inf if i is None else i, t, pos))
    many = {k for k, at in found.items() if len(k) >= least_chars and len({(i, t) for i, t, _ in at}) >= least_docs}
    first = {k: min(found[k]) for k in many} if keep_first else {}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for pos, line in enumerate(lines):
            k = line_key(line)
            if k not in many or keep_first and first[k] == (i, t or "", pos):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("least_docs", [1, 2, 3, 10])
def test_line_dedup_brute_force(many_ranges, least_docs, keep_first):
    rnd = random.Random(least_docs)
    lines = ["common", " COMMON\t", "ß", "SS", "", "  ", "a", "b ", "tab\there", "x\x0b", "\x1cy"] + [f"line {i}" for i in range(30)]
    weights = [40, 20, 3, 3, 10, 5, 9, 9, 3, 3, 3] + [2] * 30
    rows = [(i, "\n".join(rnd.choices(lines, weights, k=rnd.randrange(1, 15)))) for i in range(1, 60)]
    df = many_ranges.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_shared_lines(df, least_docs=least_docs, least_chars=1, keep_first=keep_first)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(rows, least_docs, 1, keep_first)


def test_line_dedup_hot_line_and_odd_rows(many_ranges):
    rows = [(i, "hot\n" * (i % 4) + f"own {i}\nHot ") for i in range(400)] + [(7, None), (8, ""), (9, "\n\n"), (None, "hot"), (None, "hot"), (None, None), (500, "hot\n" * 5000), (501, "z" * 100_000), (501, "z" * 100_000), (501, "other")]
    df = many_ranges.createDataFrame([(*r, *[1] * 6, b"", 1, 2, 3, 4) for r in rows], CLASH)
    for least in (2, 10, 395):
        got = sorted(map(tuple, linededup.drop_shared_lines(df, least_docs=least).collect()), key=repr)
        assert got == plain_dedup(rows, least, 1, False)
    assert linededup.drop_shared_lines(df.limit(0)).count() == 0


def test_line_streams_over_batches(spark):
    """The same ranges in batches of any size give the same rows, and what isn't settled is bounded."""
    rnd = random.Random(3)
    lines = sorted((rnd.choice([-5, -5, -5, 0, 1, 2, 3, 9]), 0, rnd.randrange(30), 0, p) for p in range(900))
    names = ["h", "k", "d", "v", "pos"]
    for cut in ([], [300, 600], [10, 450]):
        want = None
        for size in (1, 7, 64, 1000):
            out = []
            for a, b in zip([0, *cut], [*cut, len(lines)]):
                rows = lines[a:b]
                batches = [pa.RecordBatch.from_pydict({n: [r[i] for r in part] for i, n in enumerate(names)}) for part in (rows[j : j + size] for j in range(0, len(rows), size))]
                for batch in linededup._stream(10, False)(iter(batches)):
                    out += [tuple(r.values()) for r in batch.to_pylist()]
            docs = defaultdict(set)
            for h, _, d, _, _ in lines:
                docs[h].add(d)
            late, many = defaultdict(set), set()
            for h, _, d, v, _, state in out:
                if state:
                    late[h].add(d)
                    many |= {h} if state == linededup.MANY else set()
            goes = sorted((h, d, p) for h, _, d, _, p, state in out if not state or h in many or len(late[h]) >= 10)
            assert goes == sorted((h, d, p) for h, _, d, _, p in lines if len(docs[h]) >= 10)
            want = want or goes
            assert goes == want


def test_bitmaps_round_trip():
    for n, gone in ((1, [0]), (9, [8]), (9, [0, 3]), (70_000, [69_999, 5])):
        keep = linededup.unpack(linededup.pack(gone), n)
        assert sorted(np.flatnonzero(~keep)) == sorted(gone) and len(keep) == n
    assert linededup.unpack(linededup.pack([1]), 50)[2:].all() and len(linededup.pack([99_999])) < 200


# prefix trie


def plain_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    convs = {c: [x[2] for x in sorted(said)] for c, said in convs.items()}
    if rebuild:
        made = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # % keeps the sign of the dividend in SQL
        convs = made
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    own = {n: (len(m) - 1) * (len(WORD.findall(n[-1][1])) if n else 0) for n, m in members.items()}
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += own[n]
    out = []
    for n, m in members.items():
        ending = sorted(c for c in m if len(convs[c]) == len(n))
        digest = hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest()
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], digest))
    return sorted(out, key=repr)


def test_prefix_trie_brute_force(many_ranges):
    rnd = random.Random(12)
    texts = ["hi there", "Hi there", "a b c", "", " \t", "one two", "long " * 50]
    rows = [(c, t, rnd.choice("ua"), rnd.choice(texts[: 1 + c % 7])) for c in range(0, 3000, 7) for t in range(rnd.randrange(0, 9))]
    rows += [(c, t, "u", "same") for c in range(5000, 6300) for t in range(4)]  # thousands of equal conversations
    rows += [(9001, t, "a", f"turn {t}") for t in range(700)] + [(9002, t, "a", f"turn {t}") for t in range(650)]
    df = many_ranges.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefixtrie.family_trie(df)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)
    placed = prefixtrie.prefix_trie(prefixtrie.sequences(df)).collect()
    assert sorted(r.place for r in placed) == list(range(1, len(placed) + 1))
    spans = {r.place: r.end for r in placed}
    stack = []
    for place in sorted(spans):  # intervals nest, and a node's depth is the number of those around it
        while stack and stack[-1] < place:
            stack.pop()
        assert not stack or spans[place] <= stack[-1]
        assert next(r.depth for r in placed if r.place == place) == len(stack) if place % 97 == 0 else True
        stack.append(spans[place])


def test_prefix_trie_odd_rows(spark):
    rows = [(None, 1, "u", "lost"), (0, None, None, None), (0, None, "u", "b"), (0, 2, "u", "b"), (0, 2, "u", "b"), (0, 2, "a", "b"), (3, 1, "", "x y"), (20, 5, None, "x y"), (21, 1, "a", "z" * 50_000), (-3, 1, "u", "below"), (25, 1, "u", None), (1 << 40, 1, "u", "far")]
    df = spark.createDataFrame([(*r, 1, "s", "n", 2, 3, 4, "m") for r in rows], CONV_CLASH)
    got = sorted(map(tuple, prefixtrie.family_trie(df).collect()), key=repr)
    assert got == plain_trie(rows)
    plain = sorted(map(tuple, prefixtrie.prefix_trie(prefixtrie.sequences(df)).drop("place", "end").collect()), key=repr)
    assert plain == plain_trie(rows, rebuild=False)
    assert prefixtrie.family_trie(df.limit(0)).count() == 0


# resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_sample(rows, target, longest=2, least=20, percent=25, seed=7, buckets=10_000):
    def features(t):
        w = plain_words(t)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    each = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, f in each:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def test_resampling_brute_force(many_ranges):
    rnd = random.Random(4)
    vocab = ["Alpha", "beta", "é", "漢字", "x1", "ÀB", "z" * 70, "q" * 200, "is", "the"]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(0, 60)))) for i in range(300)]
    rows += [(None, "the is " * 30), (5000, None), (5001, ""), (5002, "-- !!"), (5003, "the is " * 30), (5003, "the is " * 30), (5004, "the\nis\tbeta" * 9000), (5005, "w" * 200_000)]
    target = ["the beta is", None, "alpha ALPHA", "漢字"]
    df = many_ranges.createDataFrame([(*r, *[1] * 6, b"", 1, 2, 3, 4) for r in rows], CLASH)
    aim = many_ranges.createDataFrame([(t,) for t in target], "text string")
    for longest in (1, 2, 3):
        got = sorted(map(tuple, resample.importance_sample(df, aim, longest=longest).collect()), key=repr)
        assert got == plain_sample(rows, target, longest)
    assert resample.importance_sample(df.limit(0), aim).count() == 0
    got = sorted(map(tuple, resample.importance_sample(df, aim.limit(0), percent=100).collect()), key=repr)
    assert got == plain_sample(rows, [], percent=100)


def test_crc_shifts():
    rnd = random.Random(9)
    for n in (0, 1, 2, 31, 64, 65, 1000, 123_456):
        a, b = rnd.randbytes(rnd.randrange(1, 40)), rnd.randbytes(n)
        got = resample.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


# the fit of language models


def plain_em(counts, vocab, rounds):
    """Sums over segmentations with exact bookkeeping by position, in logarithms, word by word."""
    prob = {p: 0.5 ** len(p) for p in vocab}
    total = sum(prob.values())
    prob = {p: x / total for p, x in prob.items()}
    longest = max(map(len, vocab))
    for _ in range(rounds):
        seen = dict.fromkeys(vocab, 0.01)
        for w, times in counts.items():
            edges = []
            for end in range(1, len(w) + 1):
                for start in range(max(0, end - longest), end):
                    if w[start:end] in prob:
                        edges.append((start, end, math.log(prob[w[start:end]]), w[start:end]))
                    elif end - start == 1:
                        edges.append((start, end, langid.STRANGE, None))
            a, b = [-math.inf] * (len(w) + 1), [-math.inf] * (len(w) + 1)
            a[0] = b[-1] = 0.0
            for start, end, log, _ in edges:
                a[end] = np.logaddexp(a[end], a[start] + log)
            for start, end, log, _ in reversed(edges):
                b[start] = np.logaddexp(b[start], b[end] + log)
            for start, end, log, piece in edges:
                if piece is not None:
                    seen[piece] += times * math.exp(a[start] + log + b[end] - a[-1])
        total = sum(seen.values())
        prob = {p: x / total for p, x in seen.items()}
    return np.array([prob[p] for p in vocab])


@pytest.mark.parametrize("length", [39, 40, 47, 48, 500])
def test_unknown_words_of_any_length_are_learned_from(length):
    vocab = {"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "bab": 5, "▁ab": 6}
    counts = Counter({"▁" + "漢" * length: 1, "▁abab": 7, "▁bbab": 2, "▁" + "ab" * length: 3, "▁a漢b": 2})
    got = langid._fit(counts, vocab, 3)
    assert np.isfinite(got).all() and abs(got.sum() - 1) < 1e-12
    assert np.allclose(got, plain_em(counts, vocab, 3), rtol=1e-9)


def test_rare_long_word_spoils_no_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("hello world of words", "en"), ("hallo welt der worte", "de")] * 30)]
    rows += [(i, "漢" * n + " hallo welt", "de") for i, n in enumerate((39, 47, 500, 5000), 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, PIECES).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.lang_pred == r.lang for r in got)


def test_language_query_brute_force(spark):
    """The query's labels and scores from a plain EM and a plain forward sum, over all of the smallest table."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    vocab = langid.pieces(PIECES)
    logs, langs = [], []
    rows = docs.select("doc_id", "text", "lang").collect()
    by = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            by[r.lang].update("▁" + w for w in langid.letter_words(r.text))
    for lang in sorted(by):
        langs.append(lang)
        logs.append(np.log(plain_em(by[lang], vocab, 2)))
    logs, longest, known = np.array(logs), max(map(len, vocab)), {}

    def word(w):
        if w not in known:
            a = [np.zeros(len(langs))]
            for end in range(1, len(w) + 1):
                ways = [a[s] + (logs[:, vocab[w[s:end]]] if w[s:end] in vocab else langid.STRANGE) for s in range(max(0, end - longest), end) if w[s:end] in vocab or end - s == 1]
                a.append(np.logaddexp.reduce(ways))
            known[w] = a[-1]
        return known[w]

    got = {r.doc_id: r for r in queries.QUERIES["op3_language"](spark, FOLDER).collect()}
    for r in rows:
        found = langid.letter_words(r.text)
        if not found:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = sum(word("▁" + w) for w in found)
        p = np.exp(total - total.max())
        assert got[r.doc_id].lang_pred == langs[int(total.argmax())] and abs(got[r.doc_id].score - p.max() / p.sum()) < 1e-6
