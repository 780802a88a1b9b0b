import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from editpairs.llm import packing, tokens
from editpairs.llm.elias_fano import EliasFano
from editpairs.llm.packing import packed_sequences
from editpairs.llm.token_files import Shard, read_token_files, write_token_files
from editpairs.llm.tokens import WordEncoder, tokenizer_path

TEXTS = [
    "", " ", "  ", "word", " two words ", "a  b   c", "line\nnext \n\n end", "tab\tx \ty", "it's we'll 'd", "x<|endoftext|>y <|endoftext|> z", "NBSP here   now", "\x1c a\x1db \x85 c",
    "é ÉCOLE Straße ΣΑΣ ΟΔΟΣ. é ö", "数字 123 45.6 %$ ##", "trailing\n", "\n leading", "emoji 👍🏽 👨‍👩‍👧", "a" * 5000, "<|startoftext|> q", "end   wide 　x", "́start ́x", "a\x01b c", "Foo.\nBar, x\n\ny.", "ŉ ŉA.",
]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "drop")])
@pytest.mark.parametrize("kept", [600_000, 3])
def test_words_equal_whole_texts(monkeypatch, name, spaces, kept):
    monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(TEXTS) for _ in range(5)) for _ in range(200)] + ["".join(rng.choice(" \n\tab'é.1") for _ in range(40)) for _ in range(300)]
    whole = Tokenizer.from_file(tokenizer_path(name))
    coder = WordEncoder(tokenizer_path(name), spaces)
    for _ in range(2):
        got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)]
        for t, ids in zip(texts, got):
            assert ids == whole.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "drop")])
def test_cuts_at_marks_equal_whole_texts(name, spaces):
    rng = random.Random(8)
    marks = " \n'.,!?;:<=|éÉßÿŸſİıŉµªǆΣςक़\u0301\u0327\u0338×÷각\u11a8ab1²"
    texts = ["".join(rng.choice(marks) for _ in range(rng.choice([3, 12, 40]))) for _ in range(3000)]
    whole, coder = Tokenizer.from_file(tokenizer_path(name)), WordEncoder(tokenizer_path(name), spaces)
    for t, ids in zip(texts * 2, coder.encode(texts) + coder.encode(texts)):
        assert np.frombuffer(ids, coder.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_new_words_reach_the_tokenizer_together():
    """Words with letters beyond a-z, and words before any mark, cost no call of their own."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcéèçñöß") for _ in range(9)) for _ in range(3000)})
    text = " ".join(w + rng.choice(["", "!", "?!", ";", ":", ".", ","]) for w in words)
    coder, sent = WordEncoder(tokenizer_path("word_bpe_49k.json"), "drop"), []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    whole, coder.tokenizer = coder.tokenizer, Counted()
    assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(sent) < len(words) / 100
    sent.clear()
    coder.encode([text])  # all are kept
    assert not sent


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 10**12], list(range(2000)), [7] * 600 + [2**40]])
def test_elias_fano(values):
    e = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    assert all(e.slice(a, b).tolist() == values[a:b] for a, b in ((0, 1), (3, 700), (511, 514), (1990, 5000)))
    assert e.values().tolist() == values and [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 50_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 < 50_000 * (2 + np.log2(500) + 1.5)


def rows():
    return [(i * 3, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id"), (10**12, None), (-5, "negative")]


def test_token_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, start int")
    manifest = write_token_files(docs, f"file://{tmp_path}/t", tokenizer_path("byte_bpe_50k.json"), 2)
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in sorted(rows(), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == want
    shard = Shard(manifest.orderBy("shard").first().path)
    assert shard.ids(*shard.span(0)).tolist() == want[0][3]
    empty = write_token_files(docs.filter("false"), f"file://{tmp_path}/e", tokenizer_path("byte_bpe_50k.json"), 2)
    assert read_token_files(empty).count() == 0


def check_pieces(pieces, texts, ids_of):
    by_row, sequences = {}, {}
    for p in pieces:
        by_row.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for doc, t in texts.items():
        at = 0
        for p in sorted(by_row[doc], key=lambda p: p.start):
            ids = np.array(ids_of(t), dtype="<u4")
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids_of(t))
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    return [sum(p.length for p in s) for s in sequences.values()]


@pytest.mark.parametrize("shard", [1_000_000, 6000])
def test_packing(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    rng = random.Random(4)
    topics = [[f"{c}{k}" for k in range(40)] for c in ("red", "blue", "green")]
    texts = {i: " ".join(rng.choice(topics[i % 3]) for _ in range(rng.choice([0, 1, 20, 200, 900, 5000]))) for i in range(60)} | {100: None, 101: ""}
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids_of = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]
    got = packed_sequences(spark.createDataFrame([(*r, "x") for r in texts.items()], "doc_id long, text string, shard string"), tokenizer_path("word_bpe_49k.json"), 1).collect()
    sizes = check_pieces(got, texts, ids_of)
    assert sum(n != 2048 for n in sizes) <= max(1, len({p.sequence_id >> 32 for p in got}))


def test_packing_repeats_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d")], "doc_id long, text string")
    got = packed_sequences(docs, tokenizer_path("word_bpe_49k.json"), 1).collect()
    assert sum(p.length for p in got) == 3 * 4 + 2 and len(got) == 4
    assert packed_sequences(docs.filter("false"), tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def brute_pack(docs, idf):
    """Windows by BM25 from the formula, document by document."""
    rest, sequences = [list(d[len(d) // 2048 * 2048 :]) for d in docs], []
    units = [i for i, r in enumerate(rest) if r]
    sets, average = [list(r) for r in rest], np.mean([len(rest[i]) for i in units])

    def weight(term, unit):
        tf = sets[unit].count(term)
        return idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(sets[unit]) / average))

    while any(rest):
        seed = next(i for i in units if rest[i])
        terms = sorted(set(sets[seed]), key=lambda t: (-weight(t, seed), t))[: packing.TERMS]
        score = {i: sum(weight(t, i) for t in terms) for i in units if i != seed}
        order = [seed, *sorted((i for i in score if rest[i] and score[i] > 0), key=lambda i: (-round(score[i], 9), i)), *(i for i in units if i > seed and not score.get(i))]
        room, window = 2048, []
        for i in order:
            n = min(room, len(rest[i]))
            if n:
                window.append((i, n))
                rest[i], room = rest[i][n:], room - n
        sequences.append(window)
    return sequences


def test_windows_follow_bm25():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 60, rng.choice([1, 30, 300, 900, 3000])).astype(np.uint16) for _ in range(25)]
    idf = rng.random(60).round(3) + 0.1
    got = {}
    for d, _, n, s, o in packing.pack(docs, idf):
        if not (o == 0 and n == 2048):
            got.setdefault(s, []).append((d, n))
    assert list(got.values()) == brute_pack(docs, idf)


def test_heaviest_terms():
    column = pa.array([np.array(x, "<u2").tobytes() for x in ([1, 1, 2], [2, 3], [4], [])], pa.binary())
    got = lambda weight, part, k: packing.heaviest(part, np.dtype("<u2"), np.array(weight), k).tolist()
    assert got([0, 1.0, 1.5, 1.5, 0], column, 1) == [[2], [2], [-1], [-1]] and got([0, 1.0, 1.5, 1.6, 0], column.slice(1), 1) == [[3], [-1], [-1]]
    assert got([0, 1.2, 1.5, 1.6, 0], column, 3) == [[1, 2, -1], [3, 2, -1], [-1] * 3, [-1] * 3]


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_terms_against_a_plain_version(dtype):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, n).tolist() + [65535] * (n % 3) for n in rng.choice([0, 1, 5, 60], 1200)]
    column, weight = pa.array([np.array(d, dtype).tobytes() for d in docs], pa.binary()), rng.integers(0, 4, 65536) / 2
    part = column.slice(3)
    want = [(i, t, d.count(t)) for i, d in enumerate(docs[3:]) for t in sorted(set(d))]
    assert list(zip(*(x.tolist() for x in packing.term_counts(part, np.dtype(dtype))))) == want
    heavy = lambda t, n: weight[t] * n * 2.2 / (n + 1.2)
    for d, got in zip(docs[3:], packing.heaviest(part, np.dtype(dtype), weight).tolist()):
        top = sorted((t for t in set(d) if weight[t]), key=lambda t: (-heavy(t, d.count(t)), t))[:4]
        assert got == top + [-1] * (4 - len(top))


def test_documents_of_a_common_term_keep_their_neighbours(spark, monkeypatch):
    """A term that most documents weigh most is told apart by the next ones: whole-corpus neighbours share a shard."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 700)
    rng = random.Random(6)
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    known = sorted(w for w in whole.get_vocab() if w.isascii() and w.isalpha() and len(w) > 5 and len(whole.encode(f"a {w}", add_special_tokens=False).ids) == 2)
    common, *words = rng.sample(known, 61)
    texts, topic = {}, {}
    for i in range(200):  # half of all documents have the common term first, then their topic's
        topic[i] = i % 20
        own = words[3 * topic[i] : 3 * topic[i] + 3]
        texts[i] = " ".join([common] * (25 * (topic[i] % 2)) + [own[0]] * 12 + rng.choices(own[1:], k=4))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = packed_sequences(docs, tokenizer_path("word_bpe_49k.json"), 1).collect()
    shards = {}
    for p in got:
        shards.setdefault(p.doc_id, set()).add(p.sequence_id >> 32)
    assert len({s for x in shards.values() for s in x}) > 5
    same = [len(shards[i] & shards[j]) > 0 for i in texts for j in texts if i < j and topic[i] == topic[j]]
    other = [len(shards[i] & shards[j]) > 0 for i in texts for j in texts if i < j and topic[i] != topic[j]]
    assert np.mean(same) > 0.75 and np.mean(other) < 0.2  # a shard holds some 20 documents of 200


def test_neighbours_share_terms():
    red, blue = np.arange(10, 400, dtype=np.uint16), np.arange(1000, 1390, dtype=np.uint16)
    docs = [np.random.default_rng(i).permutation(red if i % 2 else blue)[:300] for i in range(24)]
    pieces = packing.pack(docs, np.full(1400, 2.0))
    by = {}
    for d, _, n, s, _ in pieces:
        by.setdefault(s, []).append(d % 2)
    assert sum(len(set(v)) == 1 for v in by.values()) >= len(by) - 1
