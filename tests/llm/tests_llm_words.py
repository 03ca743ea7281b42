"""Invented words for the tests of this folder."""

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "zy", "dor", "fen", "gal"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def sentence(rng, n):
    return " ".join(words(rng, n)).capitalize() + "."
