"""Conversation repair, token files and ranked search against brute force, with the odd rows of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest

from pagefold.llm import conversation_repair as C
from pagefold.llm import term_pipeline as T
from pagefold.llm import token_files as K
from pagefold.llm.common import new_folder

# ---- operator 12 -------------------------------------------------------------------------------


def brute_repair(rows):
    """Counts, cost, audit and messages of ``(turn, role, text)`` rows in order, by trying every edit."""
    blank = lambda t: not re.search(r"[^\x20\x09-\x0D]", t)
    seen, faults = set(), []
    for _, role, text in rows:
        again = (role, text) in seen
        seen.add((role, text))
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if blank(text) else "duplicate" if again else "truncated" if last[0] not in ".!?" else "")

    @lru_cache(None)
    def best(i, roles):  # roles: the last initial, or "" at the start
        ways = []
        if i == len(rows) and roles in ("", "a"):
            ways.append((0, "", ()))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, m = best(i + 1, roles)
            ways.append((c + 4, "D" + a, m))
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 * (faults[i] == "truncated")
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
                if role[:1] and role[:1] in legal:
                    c, a, m = best(i + 1, role[:1])
                    ways.append((c + cut, "K" + a, ((role, text), *m)))
                for new in ("user", "assistant"):
                    if new[0] in legal:
                        c, a, m = best(i + 1, new[0])
                        ways.append((c + 3 + cut, "R" + a, ((new, text), *m)))
        return min([*ways, *inserted(i, roles)])

    @lru_cache(None)
    def inserted(i, roles, depth=2):
        if not depth:
            return ()
        new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[roles]
        after = []
        if i == len(rows) and new[0] == "a":
            after.append((0, "", ()))
        if i < len(rows):
            _, role, text = rows[i]
            after.append((lambda x: (x[0] + 4, "D" + x[1], x[2]))(best(i + 1, new[0])))
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 * (faults[i] == "truncated")
                legal = {"u": "a", "a": "u"}[new[0]]
                if role[:1] == legal:
                    after.append((lambda x: (x[0] + cut, "K" + x[1], ((role, text), *x[2])))(best(i + 1, legal)))
                full = {"u": "user", "a": "assistant"}[legal]
                after.append((lambda x: (x[0] + 3 + cut, "R" + x[1], ((full, text), *x[2])))(best(i + 1, legal)))
        after += inserted(i, new[0], depth - 1)
        return tuple((c + 3, "I" + a, ((new, ""), *m)) for c, a, m in after)

    cost, audit, messages = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha), messages


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    return tuple(sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key))


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
TEXTS = ["Yes.", "No", "", " \t\n", "Why?  \n", "é…", None, "a" * 3000 + "!", "Yes."]


def some_rows(rng, n):
    return [(rng.choice([None, *range(n)]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.6 else f"{rng.random()}{rng.choice('.! x')}")
            for _ in range(n)]


def test_divide_and_conquer_finds_the_least_audit():
    rng = random.Random(3)
    for _ in range(400):
        codes = [rng.randrange(9) for _ in range(rng.randrange(0, 12))]
        rows = []
        for i, c in enumerate(codes):
            initial, cut = divmod(c - 1, 2)
            rows.append((i, "suat"[initial] if c else "u", f"{i}{'' if cut else '.'}" if c else ""))
        want, _ = brute_repair(tuple(rows))
        cost, q = C.finish(codes)
        assert (cost, "".join(C.tokens(codes, 0, q)) + C.TAIL[q]) == want[5:7]
        # the same by segments
        cuts = sorted(rng.sample(range(1, len(codes)), min(3, len(codes) - 1))) if len(codes) > 1 else []
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        elements = [C.summary(p) for p in parts]
        assert C.finish(elements) == (cost, q)
        assert "".join(t for part, (a, b) in zip(parts, C.solve(elements, 0, q)) for t in C.tokens(part, a, b)) + C.TAIL[q] == want[6]


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_equals_brute_force(spark, partitions):
    rng = random.Random(partitions)
    convs = {i: some_rows(rng, rng.randrange(1, 9)) for i in range(60)}
    convs[None], convs[70] = some_rows(rng, 5), some_rows(rng, 400)  # a long one crosses ranges
    rows = [(c, t, r, x, False, "z", 1) for c, some in convs.items() for t, r, x in some]
    rows += [(200, 1, "user", "gone", True, "z", 1), (None, 9, "user", "gone", True, "z", 1), (3, 500, "user", "gone", True, "z", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean, digest string, seg int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result, messages = C.repair(df, messages=True, most_held=50_000)
        got = {r.conv_id: tuple(r)[1:] for r in result.collect()}
        said = {}
        for r in sorted(messages.collect(), key=lambda r: r.i):
            said.setdefault(r.conv_id, []).append((r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {*convs, 200}
    assert got[200] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c, some in convs.items():
        want, texts = brute_repair(ordered(some))
        assert got[c] == want, c
        assert said.get(c, []) == list(texts)


def test_damage_and_empty_table(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in [None, *range(4)]] + [(None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x, kind == 0)] * (2 if kind == 3 else 1)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, C.damage(df).collect()), key=key) == sorted(want, key=key)
    assert C.repair(C.damage(df.limit(0)))[0].collect() == []
    assert len(C.repair(C.damage(df))[0].collect()) == 31


# ---- operator 11 -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "Of", "TION", "don't", "é", "é", "日本", "a1", "re.", "\n", "  ", " x", "\t", "🙂", "<|endoftext|>", "x<|startoftext|>y",
             "́", "\x1c", "\x85q", "İ", "Σς", "ﬁ", "\x00", "w" * 90]
    body = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 50, 400, 2000)]
    return [(1, None), (2, ""), (3, " "), (4, "a" * 5000), (5, "\n\n  x"), *((10 + i, t) for i, t in enumerate(body)), (20, body[2]), (20, body[2]), (None, "null id")]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_word_cut_equals_the_library(texts):
    words = K.Words(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(9)
    odd = "aé 's\n\t́ <|>endoftext0ß‍日İ\x0b\x1c ."
    for text in [t or "" for _, t in texts] + ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]:
        assert np.frombuffer(words.encode(text), "<u2").tolist() == library_ids(text) if text in [t for _, t in texts] \
            else np.frombuffer(words.encode(text), "<u2").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, texts):
    schema = "doc_id long, text string, file string, start string, part string"
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], schema)
    got = K.round_trip(spark, docs, path, 2).collect()
    start, want = 0, []
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*library_ids(t or ""), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == want
    assert K.round_trip(spark, docs.limit(0), path, 2).collect() == []


def test_single_documents_are_read_by_offset(spark, texts):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(texts, schema)
    folder = new_folder(spark, "tokens")
    index = K.write(docs, folder, P.path("word_bpe_49k.json"), 2, file_bytes=200)
    assert index.select("file").distinct().count() > 3
    got = {r.doc_id: r.ids for r in K.fetch(folder, index, spark.createDataFrame([(1,), (12,), (99,)], "doc_id long")).collect()}
    assert got == {1: [2], 12: [*library_ids(dict(texts)[12]), 2]}
    name = index.filter("doc_id = 12").first().file
    reader = K.Reader(folder, name)
    files, base = K.open_folder(folder)
    reader.close()
    with files.open_input_file(f"{base}/{name}") as f:
        raw = f.read()
    with files.open_output_stream(f"{base}/cut.tok") as f:
        f.write(raw[:-1])
    with pytest.raises(ValueError):
        K.Reader(folder, "cut.tok")


# ---- operator 13 -------------------------------------------------------------------------------

def brute_search(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parsed = [(d, Counter(find(t))) for d, t in docs if find(t)]
    n_docs, n_terms = len(parsed), sum(sum(c.values()) for _, c in parsed)
    df = Counter(t for _, c in parsed for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in parsed:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made_corpus(rng, n):
    words = [f"w{i}" for i in range(120)] + ["The", "É", "日本", "a1", "x_y", "don't"]
    weight = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 5, 30, 80])))) for i in range(n)]
    return docs, words, weight


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_equals_brute_force(spark, k):
    rng = random.Random(k)
    docs, words, weight = made_corpus(rng, 400)
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # copies: ties by id
    docs += [(3000, None), (3001, ""), (3002, "-- !"), (None, docs[5][1]), (7, docs[5][1]), (3003, "the " * 30_000)]
    items = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 3, 25])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, docs[3][1]), (53, docs[3][1]), (54, docs[8][1])]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, term int, block int, score int").repartition(3)
    query = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, slot int")
    got = T.search(df, query, k, bundle_items=5, block_docs=64).collect()
    assert got[0].__fields__ == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, k)


def test_search_drops_accumulators_but_no_result(spark, monkeypatch):
    """With rare terms first and k small, owners behind the first carry fewer accumulators than there are matches."""
    rng = random.Random(1)
    docs, words, weight = made_corpus(rng, 600)
    docs = [(i, f"{t} rare{i % 40}") for i, t in docs]
    items = [(i, f"rare{i} rare{i + 1} rare{i + 2} " + " ".join(words[:6])) for i in range(10)]
    carried, plain = [], T.stage
    monkeypatch.setattr(T, "stage", lambda df, name, *a: carried.append((name, out := plain(df, name, *a))) or out)
    df, query = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = T.search(df, query, 3).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, 3)
    last = [s for n, s in carried if n.startswith("search-owner")][-1]
    assert sum(len(r["scores"]) // 8 for r in last.collect()) <= 10 * 3 * 600 // 40 < 10 * 600  # all documents match each item


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert T.search(docs, items).collect() == []
    full = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert T.search(full, items.limit(0)).collect() == []
