"""Decryption of package containers: AES-256-CBC over the first 1024 bytes, one XOR byte over the rest.

The key comes from the key id by PBKDF2, once for an id and task; it is derived in the plan that uses it and never put in a table. There is no
authentication: a wrong id gives bytes without the container's markers, not an error, and padding isn't checked. Spark's AES functions
check it, so blocks are deciphered with one more behind them, which Spark enciphers itself: a whole block of padding, chained to the last one.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import ship
from tarn.sources.container import FIRST, LAST, MARKER

# How the container's key is derived and how much of it is enciphered.
SALT, VECTOR, ROUNDS, KEY_BYTES = b"saltiest", b"the iv: 16 bytes", 1000, 32
ENCIPHERED, KEPT = 1024, 1023
DEFAULT_XOR = 0x66
_BLOCK = 16


def deciphered(blocks: Column, key: Column, vector: Column) -> Column:
    """AES-CBC of whole blocks without regard to padding."""
    modes = (F.lit("CBC"), F.lit("PKCS"))
    padding = F.substring(F.aes_encrypt(F.lit(b""), key, *modes, F.substring(blocks, -_BLOCK, _BLOCK)), _BLOCK + 1, _BLOCK)
    return F.aes_decrypt(F.concat(vector, blocks, padding), key, *modes)


@lru_cache(maxsize=1024)
def _key(key_id: str) -> bytes:
    return hashlib.pbkdf2_hmac("sha1", key_id.encode(), SALT, ROUNDS, KEY_BYTES)


def parts(data: bytes, key_id: str | None) -> tuple[bytes | None, bytes | None, bytes | None, str | None]:
    """(enciphered blocks, key, the rest in plain, None), (None, None, the whole, None) for a plain package whatever the id, or why not."""
    if len(data) >= 14 and data[0] == FIRST and data[13] == LAST:
        return None, None, data, None
    why = None
    if data.startswith(MARKER) and not key_id:
        why = "needs a key id"
    elif key_id and not re.fullmatch("wx[a-f0-9]{16}", key_id):
        why = "bad key id"
    elif not data.startswith(MARKER):
        why = "bad header"
    elif len(data) < len(MARKER) + ENCIPHERED:
        why = "too small"
    if why:
        return None, None, None, why
    head, tail = data[len(MARKER) : len(MARKER) + ENCIPHERED], data[len(MARKER) + ENCIPHERED :]
    mask = ord(key_id[-2]) if len(key_id) >= 2 else DEFAULT_XOR
    return head, _key(key_id), (np.frombuffer(tail, np.uint8) ^ np.uint8(mask)).tobytes(), None


def decrypted(df: DataFrame) -> DataFrame:
    """(pkg_id, content, key_id) to (pkg_id, content, error); neither ids nor keys are passed on."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.string())
        for batch in batches:
            rows = [parts(c or b"", k) for c, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["pkg_id", "head", "key", "rest", "error"])

    cut = df.select("pkg_id", "content", "key_id").mapInArrow(run, "pkg_id string, head binary, key binary, rest binary, error string")
    opened = F.substring(deciphered(F.col("head"), F.col("key"), F.lit(VECTOR)), 1, KEPT)
    return cut.select("pkg_id", F.when(F.col("head").isNull(), F.col("rest")).otherwise(F.concat(opened, "rest")).alias("content"), "error")
