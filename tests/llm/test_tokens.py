import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, packing, pieces, token_counts, token_files
from corpusmill.llm.queries import QUERIES
from corpusmill.session import fresh_path

from .texts import ODD

SF = "/root/testdata/sf0.001"
BYTE, WORD, RANKS = (public.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids if text else []


def batch_ids(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def odd_frame(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "no id", 1), (4, ODD[4], 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("limit", [50, 1 << 28])
def test_pieces_have_the_ids_of_whole_texts(path, limit):
    coder = pieces.PieceIds(pieces.library_encoder(path), limit)
    for lo, texts in pieces.slices(pa.array(ODD), 4000):
        ids, offsets = coder.ids(texts)
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == batch_ids(path, ODD[lo : lo + len(texts)])
        assert coder.sizes(texts).tolist() == list(map(len, got))


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (200, 16), (3000, 64)])
def test_overlapping_chunks_count_like_whole_texts(chunk, overlap):
    tokenizer = Tokenizer.from_file(BYTE)

    def encode(text):
        return tokenizer.encode(text, add_special_tokens=False)

    for text in ODD[1:-1]:
        assert token_counts.count_by_chunks(text, encode, chunk, overlap) == len(encode(text).ids), text
    assert token_counts.count_by_chunks(ODD[-1], encode, 3000, overlap) == len(encode(ODD[-1]).ids)


def test_op6(spark):
    texts = documents(spark)
    want = dict(zip(texts, map(len, batch_ids(BYTE, texts.values())), strict=True))
    got = QUERIES["op6_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in got} == {
        i: (n, len((texts[i] or "").encode()), n > 512) for i, n in want.items()
    }
    frame, rows = odd_frame(spark)
    got = token_counts.token_counts(frame, BYTE, chunk=50, overlap=8).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter(
        (i, len(ids)) for (i, _), ids in zip(rows, batch_ids(BYTE, [t for _, t in rows]), strict=True)
    )
    assert token_counts.token_counts(frame.limit(0), BYTE).collect() == []


def test_chunks_and_pieces_agree_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert docs.where(F.length("text") > token_counts.CHUNK_CHARS).count() > 0
    count = lambda chunk: {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BYTE, chunk=chunk).collect()}
    assert count(1 << 30) == count(token_counts.CHUNK_CHARS) == count(3_000)


def check_files(got, rows):
    ids = [(i, [*x, 1]) for (i, _), x in zip(rows, batch_ids(WORD, [t for _, t in rows]), strict=True)]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert names == sorted(names, key=lambda n: (n is not None, n or 0))


def test_op5(spark):
    check_files(QUERIES["op5_token_files"](spark, SF).collect(), list(documents(spark).items()))
    frame, rows = odd_frame(spark)
    for bits in (False, True):
        folder = fresh_path(spark, "files")
        token_files.write_tokens(frame, WORD, folder, 1, bits=bits, chunk_ids=200)
        check_files(token_files.read_digests(spark, folder).withColumnRenamed("id", "doc_id").collect(), rows)
        assert spark.read.parquet(f"{folder}/index").count() > 3
    whole = {r.id: r.ids for r in token_files.read_tokens(spark, folder).collect()}
    assert whole[9] == [*library_ids(WORD, ODD[9]), 1]
    folder = fresh_path(spark, "files")
    token_files.write_tokens(frame.limit(0), WORD, folder, 1)
    assert token_files.read_digests(spark, folder).collect() == []


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [255, 65_535, 1 << 31])
def test_chunks_round_trip(bits, top):
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 20_000, 8_192, 0, 3])
    ids = rng.integers(0, top, sizes.sum()).astype(np.uint32)
    back = token_files.decode_chunk(token_files.encode_chunk(ids, [5, None, -1, 7, 7, 0], sizes, bits))
    assert back[0].tolist() == ids.tolist() and back[1] == [5, None, -1, 7, 7, 0] and back[2].tolist() == sizes.tolist()
    assert token_files.decode_chunk(token_files.encode_chunk(ids[:0], [], sizes[:0], bits))[1] == []
    with pytest.raises(ValueError):
        token_files.decode_chunk(b"x" * 100)


def check_packed(got, rows, sequence=2048):
    left = defaultdict(list)
    for r in got:
        left[r.doc_id, r.doc_tokens].append(r)
    wanted = Counter()
    for (i, _), x in zip(rows, batch_ids(BYTE, [t for _, t in rows]), strict=True):
        ids = [*x, 1]
        for at in range(0, len(ids), sequence):
            part = ids[at : at + sequence]
            wanted[i, at, len(part), crc(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == wanted
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for held in inside.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= sequence
    return sum(r.length for r in got) / (len(inside) * sequence)


def test_op4(spark):
    assert check_packed(QUERIES["op4_packing"](spark, SF).collect(), list(documents(spark).items())) > 0.97
    frame, rows = odd_frame(spark)
    check_packed(packing.pack(frame, BYTE, 1, sequence=64).collect(), rows, 64)
    assert packing.pack(frame.limit(0), BYTE, 1).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame, BYTE, 1, sequence=1025)


def test_plan_places_every_piece_near_the_bound():
    rng = np.random.default_rng(2)
    for scale in (1, 40, 5000):
        demand = rng.integers(0, scale + 1, 128)
        patterns, counts = packing.plan(demand, 128)
        sizes = np.arange(1, 129)
        assert (counts @ patterns == demand).all() and (patterns @ sizes <= 128).all()
        columns, x = packing.solve(demand, 128)
        assert (columns @ sizes <= 128).all() and np.allclose(x @ columns, demand)
        assert counts.sum() <= x.sum() + 40


def test_pricing_finds_the_best_pattern():
    rng = np.random.default_rng(3)
    for _ in range(20):
        values = rng.random(9)
        best, pattern = packing.price(values, 9)
        table = [0.0]
        for c in range(1, 10):
            table.append(max([table[c - 1]] + [values[k - 1] + table[c - k] for k in range(1, c + 1)]))
        assert abs(best - table[9]) < 1e-12 and abs(pattern @ values - best) < 1e-12
        assert pattern @ np.arange(1, 10) <= 9


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(got, rows):
    encoding = reference_encoding()
    want = Counter()
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_op8(spark):
    check_bpe(QUERIES["op8_byte_bpe"](spark, SF).collect(), list(documents(spark).items()))
    frame, rows = odd_frame(spark)
    check_bpe(bpe.digests(frame, RANKS, public.PATTERN).withColumnRenamed("id", "doc_id").collect(), rows)
    back = bpe.decode(bpe.encode(frame, RANKS, public.PATTERN), RANKS).collect()
    assert Counter((r.id, bytes(r.bytes).decode()) for r in back) == Counter((i, t or "") for i, t in rows)
    assert bpe.digests(frame.limit(0), RANKS, public.PATTERN).collect() == []


def plain_merges(word, ranks):
    parts = [word] if word in ranks else [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_replay_follows_the_plain_rule_on_awkward_ranks():
    # Ranks that no training gives: a merge can uncover a pair of lower rank.
    rng = random.Random(9)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 300:
            token = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))).encode()
            ranks.setdefault(token, len(ranks))
            if len(ranks) >= 256 + 3 + 9 + 27:
                break
        words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))).encode() for _ in range(60)})
        words.append(b"a" * 200)
        want = [plain_merges(w, ranks) for w in words]
        assert [bpe.encode_word(w, ranks) for w in words] == want
        assert bpe.Replay(ranks).encode(words) == want
