"""Texts that tests make up."""

import random

SF = "/root/testdata/sf0.001"
VOCABULARY = ["".join(random.Random(i * 31 + j).choice("bcdfghjklmnprst") + random.Random(i * 7 + j).choice("aeiou") for j in range(2 + i % 3)) for i in range(400)]


def sentence(g: random.Random, words: int) -> str:
    return " ".join(g.choice(VOCABULARY) for _ in range(words)).capitalize() + "."
