import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import DOCS, odd_rows, sha256
from vecflow.llm import bpe, packing
from vecflow.llm.queries import tokenizer_path

PATH = tokenizer_path()
SAMPLES = list("abc ABC's 'LL Éñß ΣσςΑ İıIi 123٣½ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎​ 　﻿中😀👍🏽éﬁǅ!?.,;<|>%$#|_-\x00ก็") + [
    "<|endoftext|>", "<|startoftext|>", "'s", "can't", "thing", "ΟΔΟΣ", "İstanbul"]


@pytest.fixture(scope="module")
def pair():
    return bpe.ForcedBoundaryBPE(bpe.read_tokenizer(PATH)), Tokenizer.from_file(PATH)


def test_encodes_and_decodes_as_the_library(pair):
    mine, ref = pair
    rng = random.Random(1)
    texts = ["".join(rng.choice(SAMPLES) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += ["ab" * 3000 + "xyz", "thing" * 2000, "ÿé" * 1500, "".join(rng.choice("abcdethin") for _ in range(5000))]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want
        assert mine.decode(want) == ref.decode(want, skip_special_tokens=False)


def test_every_code_point(pair):
    """Alone and inside a word; of the planes without any assigned character every 97th."""
    mine, ref = pair
    points = [chr(c) for p in range(17) for c in range(p << 16, (p + 1) << 16, 1 if p in (0, 1, 2, 3, 14) else 97)
              if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 2048):
        for text in (" ".join(points[lo:lo + 2048]), " ".join(f"A{c}\u0301B1{c}" for c in points[lo:lo + 2048])):
            if mine.encode(text) != ref.encode(text, add_special_tokens=False).ids:
                odd = [c for c in text.split(" ") if mine.encode(c) != ref.encode(c, add_special_tokens=False).ids]
                raise AssertionError(f"{len(odd)} chunks differ, {odd[:5]!r}")
    odd = "Hello \u0558Wor\u1c89ld, \U000323b0\u0301 it's <|endoftext|>\u0558 x" + " y\u058c" * 50
    want = ref.encode(odd, add_special_tokens=False).ids
    assert mine.encode(odd) == want and mine.decode(want) == ref.decode(want, skip_special_tokens=False)


def test_windows_do_not_change_the_ids(pair, monkeypatch):
    mine, ref = pair
    text = " ".join(f"word{i} é," for i in range(400))
    monkeypatch.setattr(bpe, "WINDOW", 50)
    assert len(list(mine.windows(text))) > 10 and mine.encode(text) == ref.encode(text, add_special_tokens=False).ids


def test_cuts_are_never_inside_a_token(pair):
    mine, ref = pair
    rng = random.Random(2)
    cut = 0
    for _ in range(500):
        word = "".join(rng.choice("aqxzéÿ漢jk") for _ in range(8)).lower()
        data = word.encode()
        cut += len(mine.cuts(data))
        spans = [len(bytes(mine.tokens[i].removesuffix(mine.suffix), "utf-8", "ignore").decode()) for i in mine.encode(word)]
        ends = set(np.cumsum(spans).tolist())
        if ref.encode(word, add_special_tokens=False).ids and word.isalpha():
            assert set(mine.cuts(data)) <= ends
    assert cut > 100


def test_bounded_cache_keeps_what_is_found():
    c = bpe.Cache(8)
    for i in range(100):
        c.keep(str(i), b"x")
        assert c.find("0") == b"x" and len(c.new) <= 4 and len(c.old) <= 4


def test_query_columns_on_odd_rows(spark, pair):
    mine, ref = pair
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    want = []
    for r in rows:
        ids = ref.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha256(np.array(ids, "<u4").tobytes()), sha256(ref.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.encode_digests(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    full = {(r.doc_id, tuple(r.ids)) for r in bpe.encode_documents(df, PATH).collect()}
    assert full == {(r[0], tuple(ref.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows}
    assert bpe.encode_digests(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.parametrize("case", ["mixed", "half", "small", "full", "one", "none"])
def test_pack(case):
    rng = np.random.default_rng(0)
    lengths = {"mixed": np.clip(rng.lognormal(6.3, 0.9, 3000).astype(int) + 1, 1, 2048), "half": np.full(999, 1024), "small": rng.integers(1, 40, 2000),
               "full": np.full(10, 2048), "one": np.array([5]), "none": np.array([], dtype=int)}[case]
    seq, off = packing.pack(lengths)
    held = collections.defaultdict(list)
    for s, o, n in zip(seq.tolist(), off.tolist(), lengths.tolist()):
        held[s].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(held) <= 1.02 * -(-int(lengths.sum()) // 2048) + 1


def test_pack_documents(spark, pair):
    _, ref = pair
    rows = odd_rows()
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(3), PATH).collect()
    want = collections.Counter()
    for r in rows:
        ids = np.array(ref.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[r[0], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = [0] + list(np.cumsum([n for _, n in sorted(parts)]))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
