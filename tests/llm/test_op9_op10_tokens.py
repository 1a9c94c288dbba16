import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import SF, TEXTS, docs, given, same, with_extra
from polyglint.llm import bpe, bpe_reuse, token_store
from polyglint.llm.queries import QUERIES


@functools.cache
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.vocabulary())


def ids_of(text):
    return np.array(library().encode(text or "", add_special_tokens=False).ids, "<u4")


ODD = ["", " ", "  ", "\n", " a", "a ", "a \n b", "it's  'S don't", "x<|endoftext|>", " <|endoftext|>\n", "\x1c a\x1c b", "a\r\nb c",
       "word.word,word", "hello.... wor;ld!!", "ŉn ɐɐ ŉ.", "ª. º! µ? ²3", "naïve's.", ". . .", "Ⅷ. x٣. ٣!", "a.\n\nb. \n c", " . a  b"]


def odd_texts(n=3000):
    rnd = random.Random(11)
    letters = " \n\n  .,'!?sdtm\t\r éñaBc12½你ǆɐ -_<|>😀́"
    out = ODD + [t for t in TEXTS if t]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    out += ["".join(rnd.choice([" the", "ing", "\n", " a", ".", "'s", " 12", "  ", "你"]) for _ in range(700)) for _ in range(20)]
    return out


def test_units_and_chunks_agree_with_the_library():
    units, chunks, fine = bpe.UnitEncoder(bpe.vocabulary(), max_units=50), *(
        bpe_reuse.ChunkEncoder(bpe.vocabulary(), kept=1000, bits=b) for b in (9, 3))
    for t in odd_texts():
        want = ids_of(t)
        for enc in (units, chunks, fine):
            assert enc.encode(t) == want.tobytes(), t
        assert units.decode(want.tolist()) == library().decode(want.tolist(), skip_special_tokens=False)


def test_chunks_are_cut_by_content():
    rnd = random.Random(4)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    cut = lambda t: {t[a:b] for a, b in zip([0, *bpe_reuse.cuts(t)], bpe_reuse.cuts(t))}
    a, b = cut("one " + shared), cut("another start " * 9 + shared + " tail")
    assert len(a & b) >= len(a) - 3 and len(a) > 20
    for t in odd_texts(50):
        ends = bpe_reuse.cuts(t)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(t)


def test_op10(spark):
    df = docs(spark)
    want = lambda rows: [(i, len(ids_of(t)), hashlib.sha256(ids_of(t).tobytes()).hexdigest(), hashlib.sha256(
        library().decode(ids_of(t).tolist(), skip_special_tokens=False).encode()).hexdigest()) for i, t in rows]
    same(bpe_reuse.digests(with_extra(df)).collect(), want([(r.doc_id, r.text) for r in df.collect()]))
    same(QUERIES["op10_bpe_chunks"](spark, SF).collect(), want([(r.doc_id, r.text) for r in given(spark).collect()]))
    assert bpe_reuse.digests(df.limit(0)).count() == 0
    back = bpe_reuse.decode(bpe_reuse.encode(with_extra(df))).select("text", "ids", "decoded")
    for r in back.collect():
        assert r.ids == ids_of(r.text).tolist() and r.decoded == (r.text or "")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def op9(rows):
    out, start = [], 0
    for i, t in ordered(rows):
        ids = np.append(ids_of(t), 0).astype("<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op9(spark, tmp_path):
    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    same(token_store.stored(with_extra(df)).collect(), op9(rows))
    same(token_store.stored(df, bits=True, block_ids=1000, part_ids=5000).collect(), op9(rows))
    same(QUERIES["op9_token_planes"](spark, SF).collect(), op9([(r.doc_id, r.text) for r in given(spark).collect()]))
    token_store.write(df.limit(0), str(tmp_path / "none"))
    assert token_store.digests(spark, str(tmp_path / "none")).count() == 0
    token_store.write(df, str(tmp_path / "ids"), part_ids=3000)
    for (i, t), r in zip(ordered(rows), sorted(token_store.read(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)):
        assert r.doc_id == i and r.ids == [*ids_of(t).tolist(), 0]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 70_001])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4")
    index, data = token_store.pack(ids, block_ids=4096, bits=bits)
    assert (token_store.unpack(index, data) == ids).all()
    assert all(len(b["ends"]) == (32 if bits else 4) for b in index)
