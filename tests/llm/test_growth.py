import re


def test_byte_bpe_remembers_half_a_million_pieces():
    """A long table's frequent words stay known after many rare ones."""
    from tracegauge.llm import bpe

    codec = object.__new__(bpe.Codec)
    asked = []
    codec.ranks, codec.pattern, codec.known, codec.held = {}, re.compile(r"\S+"), {}, 0
    codec.encode_pieces = lambda pieces: asked.append(len(pieces)) or [b"\1\0\0\0"] * len(pieces)
    text = " ".join(f"w{i}" for i in range(500_000))
    for _ in range(2):
        codec.encode([text])
    assert asked == [500_000, 0]
