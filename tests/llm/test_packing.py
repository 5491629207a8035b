"""Token ids against the tokenizer itself, packing against its definition."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanveil.llm import packing, shingles, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["", None, " ", "a  b\tc\nd", "don't. 'S ,x<|endoftext|> <|ENDOFTEXT|> <|startoftext|>x", "É é a̸ x≠ ̸y", "x" * 5000, "!!?..,a.b.c'll",
           "wide　blank x", "ΑΣ ΑΣ. 12,5.6% ٣", "The the THE", "a.́b ,̈", "\U0001f600 ok \x00 z"]


def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("piece", [16, 1 << 21])
def test_ids_by_word(monkeypatch, piece):
    monkeypatch.setattr(shingles, "PIECE", piece)
    plain = Tokenizer.from_file(PATH)
    r = random.Random(2)
    texts = AWKWARD + ["".join(r.choices(["a", "The ", "cat", "'s ", ", ", "é", "\n", "12 ", "<|", "Ω."], k=r.choice([1, 9, 200]))) for _ in range(200)]
    encoder = token_ids.Encoder(spec(), kept=50)
    assert encoder.by_word
    for _ in range(2):
        got = encoder.ids(pa.array(texts, pa.string()))
        assert [g.tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_see_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_ids.Encoder(f.read())
    assert not encoder.by_word
    assert encoder.ids(pa.array(["a  b", None]))[0].tolist() == encoder.tokenizer.encode("a  b", add_special_tokens=False).ids


def test_fullest_combination():
    r = random.Random(5)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(0, 9))]
        room, counts = r.randint(0, 60), Counter(items)
        chosen = packing.fullest(dict(counts), room, sorted(counts, reverse=True))
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


def test_plan_takes_everything_once():
    r = random.Random(6)
    for top, n in ((100, 500), (2048, 3000), (7, 10_000)):
        counts = Counter(r.randint(1, top) for _ in range(n)) + Counter({1: 3000})
        made, used = packing.plan(dict(counts)), Counter()
        for times, chosen in made:
            assert sum(k * v for k, v in chosen.items()) <= 2048
            used.update({k: v * times for k, v in chosen.items()})
        assert used == counts
        bound = max(-(-sum(k * v for k, v in counts.items()) // 2048), sum(v for k, v in counts.items() if k > 1024))
        assert sum(t for t, _ in made) <= 1.01 * bound + 1
    # repeating a combination is what single steps come to
    counts, steps = Counter({900: 5, 600: 7, 300: 4, 48: 3}), 0
    left = dict(counts)
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = Counter(packing.fullest(left, 2048 - longest, sorted(left, reverse=True)))
        for k, v in chosen.items():
            left[k] -= v
        left = {k: v for k, v in left.items() if v}
        steps += 1
    assert steps == sum(t for t, _ in packing.plan(dict(counts)))


SCHEMA = "doc_id long, text string, `a.b` int, Length string, none string"


def test_pack(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(["cat", "The", "xyzzy", "12,"], k=r.choice([0, 1, 30, 300]))), i, "own", None) for i in range(400)]
    rows += [(900, None, 1, "own", "n"), (901, "", 1, None, "n"), (3, rows[3][1], 1, "own", "n"), (None, "word " * 9000, 1, "own", "n")] + [(77, "same text", 1, "own", "n")] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = packing.pack(df, PATH, capacity=256, share_rows=100)
    assert out.columns == ["doc_id", "a.b", "none", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = out.collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.update((i, k, a, tuple(ids[a:a + 256])) for k, a in enumerate(range(0, len(ids), 256)))
    assert Counter((x["doc_id"], x["piece"], x["start"], tuple(x["ids"])) for x in got) == want
    by = defaultdict(list)
    for x in got:
        assert x["length"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        by[x["sequence_id"]].append((x["offset"], x["length"], x["ids"]))
    total = sum(x["length"] for x in got)
    assert sorted(by) == list(range(len(by))) and len(by) <= -(-total // 256) + 1
    whole = {x["sequence_id"]: (x["length"], x["ids"]) for x in packing.sequences(out).collect()}
    for s, parts in by.items():
        at, ids = 0, []
        for offset, length, part in sorted(parts):
            assert offset == at
            at += length
            ids += part
        assert at <= 256 and whole[s] == (at, ids)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_tasks_of_a_worker_share_the_words_and_letters_are_encoded_together():
    a, b = token_ids.worker_encoder(spec()), token_ids.worker_encoder("".join([spec()]))
    assert a is b
    words = ["plain", "Öffnung", "don't", "a1b", "x", "ﬁne", "日本語", "word", "été", "ªº", "ͅa", "ʼn", "..", "İstanbul"] * 3 + [f"w{chr(97 + i % 26)}{'z' * (i % 7)}" for i in range(200)]
    texts = [" ".join(words[i::5]) for i in range(5)]
    whole = token_ids.Encoder(spec(), by_word=False)
    fresh, calls = token_ids.Encoder(spec()), []
    encode = fresh._encode
    fresh._encode = lambda t: calls.append(len(t)) or encode(t)
    for _ in range(2):
        for got, want in zip(fresh.ids(pa.array(texts)), whole.ids(pa.array(texts)), strict=True):
            assert got.tolist() == want.tolist()
        assert sum(calls) < len(set(words)) / 2  # the second time none
    assert fresh._encode_words(["a", "1"])[0].tolist() == [1, 1]
