from __future__ import annotations

import pytest

from rankloom.llm.common import begin


@pytest.fixture(autouse=True)
def settings(spark):
    begin(spark)


WORDS = [f"w{i}x" for i in range(400)]


def prose(seed: int, n: int, start: int = 0) -> str:
    """n words that follow from the seed."""
    return " ".join(WORDS[(start + seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] for i in range(n))
