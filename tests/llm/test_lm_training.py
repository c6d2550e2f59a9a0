"""The attention head is trained on every block of every training document."""

import numpy as np
import public_tokenizers

from recollect.llm import lm_scoring as M
from recollect.llm.byte_bpe import read_ranks


def test_every_block_of_every_training_document_is_handed_to_training(spark):
    pieces = M.Pieces(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    texts = ["one two three four five six seven " * 30, "", "a b", None, "long " * 500]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = M._count(docs, pieces, M.RATE).where("block is not null").count()
    ids, first = M.ids_of(pieces, M.Run.of([(t or "").encode() for t in texts]))
    assert got == sum(-(-int(n) // M.BLOCK) for n in np.diff(np.r_[first, len(ids)]))


def test_a_task_trains_on_each_of_its_blocks(monkeypatch):
    blocks = np.arange(25 * 3 * M.BLOCK).reshape(25, -1) % 600
    blocks[:, 0] = np.arange(25)
    seen, attend = [], M.attend

    def told(q, kv, near, x, opens, bounded=True):
        seen.append(x[:, 0].tolist())
        return attend(q, kv, near, x, opens, bounded)

    monkeypatch.setattr(M, "attend", told)
    m = M.untrained(600)
    p = M.trained(M.first_weights(600), m.classes, m.after, blocks.astype("<i4"), 3, 0.005, 0, 10)
    assert {i for s in seen for i in s} == set(range(25)) and all(len({*s}) == len(s) for s in seen)
    assert all(np.isfinite(v).all() for v in p.values())
