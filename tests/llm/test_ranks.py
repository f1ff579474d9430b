import numpy as np
import public_tokenizers as P

from landwatch.llm import bpe


def test_a_worker_holds_only_what_its_step_reads():
    """Pairs are plain arrays until a piece is too long for a matrix; decoding reads no pairs at all."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(path, P.PATTERN)
    short, _ = encoder(["some words, 12 numbers"])
    assert "lookup" not in vars(encoder.ranks) and not any(isinstance(v, dict) for v in vars(encoder.ranks).values())
    long = "ab" * 400
    ids, _ = encoder([long])
    assert "lookup" in vars(encoder.ranks)
    entries = bpe.Entries(path)
    text = lambda found: b"".join(entries.raw[entries.starts[i]:entries.starts[i] + entries.sizes[i]].tobytes() for i in found)
    assert text(ids) == long.encode() and text(short) == b"some words, 12 numbers"
    assert not any(isinstance(v, bpe.PairTable) for v in vars(entries).values()) and len(np.unique(entries.starts[entries.sizes > 0])) > 50000 - 300
