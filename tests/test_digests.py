"""Whirlpool: the standard's answers, and a byte-by-byte model on the documents."""

from millrace.functions import digests
from millrace.plans import QUERIES

ANSWERS = {
    b"": "19fa61d75522a4669b44e39c1d2e1726c530232130d407f89afee0964997f7a73e83be698b288febcf88e3e03c4f0757ea8964e59b63d93708b138cc42a66eb3",
    b"abc": "4e2448a4c6f486bb16b6562c73b4020bf3043e3a731bce721ae1b303d97e6d4c7181eebdb6c57e277d0e34957114cbd6c797fc9d95d8b582d225292076d4eef5",
    b"The quick brown fox jumps over the lazy dog": "b97de512e91e3828b40d2b0fdce9ceb3c4a71f9bea8d88e75c4fa854df36725fd2b52eb6544edcacd6f8beddfea403cb55ae31f03ad62a5ef54e42ee82c3fb35",
}


def by_bytes(text):
    """The standard's steps on a matrix of 8 x 8 bytes."""
    box = digests.substitution().tolist()

    def times(a, b):
        out = 0
        while b:
            out ^= a * (b & 1)
            a, b = (a << 1) ^ (0x11D if a & 128 else 0), b >> 1
        return out

    products = {f: [times(b, f) for b in range(256)] for f in (1, 2, 4, 5, 8, 9)}
    row = (1, 1, 4, 1, 8, 5, 2, 9)

    def step(m):
        s = [[box[m[(i - j) % 8][j]] for j in range(8)] for i in range(8)]
        out = [[0] * 8 for _ in range(8)]
        for i in range(8):
            for j in range(8):
                for k in range(8):
                    out[i][j] ^= products[row[(j - k) % 8]][s[i][k]]
        return out

    xor = lambda a, b: [[x ^ y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]
    padded = text + b"\x80" + bytes(-(len(text) + 33) % 64) + (8 * len(text)).to_bytes(32, "big")
    state = [[0] * 8 for _ in range(8)]
    for at in range(0, len(padded), 64):
        block = [list(padded[at + 8 * i : at + 8 * i + 8]) for i in range(8)]
        key, mixed = state, xor(block, state)
        for r in range(10):
            key = step(key)
            key[0] = [a ^ box[8 * r + j] for j, a in enumerate(key[0])]
            mixed = xor(step(mixed), key)
        state = xor(xor(mixed, block), state)
    return bytes(b for line in state for b in line).hex()


def test_known_answers():
    assert dict(zip(ANSWERS, digests.digest_batch(list(ANSWERS)), strict=True)) == ANSWERS
    assert digests.digest_batch([]) == []


def test_borders_of_blocks_and_batches():
    texts = [bytes([k % 251]) * k for k in (*range(28, 36), *range(62, 67), 95, 96, 97, 128, 300)]
    assert digests.digest_batch(texts) == [by_bytes(t) for t in texts]
    assert digests.digest_batch([b"a" * 1_000_000])[0].startswith("0c99005beb57eff50a7cf005560ddf5d29057fd86b20bfd62deca0f1ccea4af5")


def test_one_row_for_each_document(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.digest for r in QUERIES["digests_512"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    some = [d for d, t in docs.items() if t is not None and len(t) < 1_500][:40]
    assert len(some) > 20 and all(got[d] == by_bytes(docs[d].encode()) for d in some)


def test_null_has_none(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(None,), ("",), ("é",)], "t string").select("t", digests.digest_512(F.col("t")).alias("d")).collect()
    assert [r.d for r in d] == [None, ANSWERS[b""], by_bytes("é".encode())]
