"""Tokenizers, repeated strings and the Jaccard join against brute force, with the odd rows of each."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from pagefold.llm import bpe, ngram_jaccard, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, ids string, n_tokens string, key string"


def frame(spark, texts, schema=SCHEMA):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], schema)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "of", "tion", "ingst", "é", "日本", "a1", "re.", "\n", "  ", "don't", "\t", "🙂", "<s>", "▁", "\x00"]
    body = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 50, 400)]
    return [(1, None), (2, ""), (3, " "), (4, "a" * 5000), (5, "\n\n  x"), *((10 + i, t) for i, t in enumerate(body)), (20, body[2]), (20, body[2])]


def test_bpe_equals_the_library_and_decodes(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    vocabulary = bpe.Vocabulary(open(path, "rb").read(), P.PATTERN)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rows = bpe.token_digests(frame(spark, texts), path, P.PATTERN).collect()
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert bpe.token_digests(frame(spark, [], SCHEMA), path, P.PATTERN).collect() == []


def test_rank_queue_finds_the_lowest_rank():
    queue, rng, held = bpe.RankQueue(), random.Random(1), []
    for _ in range(2000):
        if rng.random() < 0.6 or not held:
            held.append((rng.choice([0, 63, 64, 4095, 4096, 50_255, rng.randrange(50_256)]), rng.randrange(100)))
            queue.push(*held[-1])
        else:
            rank = queue.first()
            assert rank == min(held)[0]
            from heapq import heappop

            at = heappop(queue.buckets[rank])
            assert (rank, at) == min(held)
            held.remove((rank, at))
            if not queue.buckets[rank]:
                queue.drop(rank)


def test_merge_of_many_pieces_equals_each_alone(texts):
    vocabulary = bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    pieces = [w.encode() for _, t in texts for w in vocabulary.split(t or "")] + [b"", b"ab" * 300]
    assert vocabulary.merge(pieces) == [vocabulary.merge([p])[0] for p in pieces]


def test_token_counts_equal_the_library(spark, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.count_tokens(frame(spark, texts), path, limit=60).collect()
    want = []
    for i, t in texts:
        n = len(library.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 60))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert token_counts.count_tokens(frame(spark, []), path).collect() == []
    words = ["", "the", "日本", "x" * 40]
    packed = token_counts.pack_table(words, library)
    assert token_counts.unpack_table(packed) == {w: len(library.encode(w)) if w else 1 for w in words}


# ---- repeated strings ------------------------------------------------------------------------------

def removed(docs, length=50):
    """Brute force: per (doc_id, text) the covered bytes."""
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < i:
                gone[k:k + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(25), prose(12)
    docs = [(i, prose(rng.randrange(5, 60))) for i in range(20)]
    docs += [(100 + i, prose(10) + passage + prose(8)) for i in range(6)]  # one passage between different neighbours
    docs += [(200 + i, docs[3][1]) for i in range(4)]  # exact copies
    docs += [(300, "ab" * 400), (301, "ba" * 300), (302, "x" * 49), (303, "x" * 49), (304, "y" * 50), (305, "y" * 51)]
    docs += [(400 + i, line[:55] + str(i) + line[55:]) for i in range(5)]
    docs += [(500, None), (501, ""), (502, passage + passage), (502, passage), (7, docs[0][1])]  # ids told twice
    rng.shuffle(docs)
    return docs


def test_repeats_equal_brute_force(spark, repeats):
    df = frame(spark, repeats).repartition(3)
    assert sorted(map(tuple, suffix_dedup.digests(df).collect())) == sorted(removed(repeats))


def test_repeats_of_nothing_and_of_null_ids(spark):
    assert suffix_dedup.digests(frame(spark, [])).collect() == []
    rows = suffix_dedup.digests(frame(spark, [(None, "z" * 80), (5, "z" * 80), (None, "z" * 80), (6, "z" * 80)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 0), (5, 0), (6, 80)]


def test_cut_texts_keep_whole_characters_and_columns(spark):
    shared = "é" * 40
    docs = spark.createDataFrame([(1, "a" + shared + "b", "en", "s", 42), (2, "cé" + shared + "éd", "fr", "s", 44), (3, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].text == "a" + shared + "b" and got[1].n_chars == 42 and got[3].text is None
    assert got[2].text in ("céd", "cd", "cééd") and got[2].n_chars == len(got[2].text) and got[2].lang == "fr"


def test_merged_intervals_equal_sorted_suffixes():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 80))) for _ in range(30)]
    strings += [strings[0], strings[1][:60], "ab" * 40]
    width = 84
    shards = []
    for part in (strings[:10], strings[10:11], strings[11:]):
        rows = np.zeros((len(part), width), np.uint8)
        for i, s in enumerate(part):
            rows[i, :len(s)] = np.frombuffer(s.encode(), np.uint8)
        shards.append((rows, np.array([len(s) for s in part])))
    built = [suffix_dedup.Shard(r, n) for r, n in shards]
    place, interval = suffix_dedup.merge(built, 50)
    at, seen = [0] * len(built), {}
    for p, v in zip(place.tolist(), interval.tolist()):
        b = built[p]
        s = shards[p][0][b.row[at[p]], b.offset[at[p]]:shards[p][1][b.row[at[p]]]].tobytes()[:50]
        at[p] += 1
        if len(s) == 50:
            assert seen.setdefault(v, s) == s
    assert len(set(seen.values())) == len(seen)


# ---- Jaccard join ----------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def linked(docs, k, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and root(a) != root(b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(docs):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted((i, len(sets[a]), least[root(a)]) for a, (i, _) in enumerate(docs))


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for n in (1, 3, 4, 5, 8, 12, 20, 35, 60, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for copy in range(9):
            w = list(base)
            for _ in range(copy * max(1, n // 60) // 2):
                at = rng.randrange(len(w)) if w else 0
                w[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [*w[at:at + 1], rng.choice(vocabulary)]])
            docs.append((len(docs) * 7 % 1009, " ".join(w).upper() if copy == 3 else "\t".join(w)))
    docs += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE")]
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_jaccard.components(frame(spark, docs).repartition(5), k, percent).collect()
        assert sorted(map(tuple, got)) == linked(docs, k, percent)


def test_jaccard_odd_rows(spark):
    assert ngram_jaccard.components(frame(spark, [])).collect() == []
    rows = ngram_jaccard.components(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (3, 3), (3, 3), (4, 3)]


def test_block_sketches_meet_whenever_sets_are_close():
    """No linked pair is lost whatever the sizes: sets at exactly the threshold share a key."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        bands = ngram_jaccard.Bands(percent)
        for n in [*range(1, 60), 100, 333, 1000, 4000]:
            whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            least = -(-percent * len(whole) // 100)
            for _ in range(3):
                part = np.sort(rng.choice(whole, least, replace=False))
                if len(part) == len(whole):
                    continue
                a, b = (set(np.concatenate([np.zeros(0, np.uint64), *bands.keys(x)]).tolist()) for x in (whole, part))
                assert a & b, (percent, n)
                bits = [ngram_jaccard.bit_sketch(x).tobytes() for x in (whole, part)]
                assert ngram_jaccard.sketch_distance(*bits) <= len(whole) - len(part)
