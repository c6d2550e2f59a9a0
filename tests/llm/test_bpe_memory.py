"""Memos of a worker are bounded by what three of them may take beside the JVM."""

import public_tokenizers

from recollect.llm import byte_bpe as B


def test_memos_stay_within_their_bound():
    enc = B.Encoder(B.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert all(m.limit <= 100_000 for m in (enc.piece, enc.chunk, enc.bytes))
    for i in range(2 * B.KNOWN + 1_000):
        enc.decode(enc.ids(f"w{i}"))
    assert all(len(m) + len(m.old) <= 2 * B.KNOWN for m in (enc.piece, enc.chunk, enc.bytes))
    assert enc.decode(enc.ids("w5 w6")) == b"w5 w6"
