"""Very long inputs: work in proportion to their length."""

import base64
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from toposim.llm import blocks, bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Encoder(PATH, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["a" * 1_000_000, "-" * 300_000, "".join(random.Random(1).choices("ACGT", k=500_000)), "ha" * 100_000,
                                  "".join(random.Random(2).choices("abcdefghé", k=60_000)), "x " + "é" * 9_000 + " y"])
def test_long_pretokens(both, text):
    began = time.time()
    got = np.frombuffer(both[0].encode([text])[0], "<u4").tolist()
    assert time.time() - began < 20
    assert got == both[1].encode_ordinary(text)


def test_long_block_of_inline_tags():
    page = "<article><p>" + "<i>word</i> " * 400_000 + "</p></article>"
    began = time.time()
    (block,) = blocks.blocks(page)
    assert time.time() - began < 30 and len(block.text) == 5 * 400_000 - 1
