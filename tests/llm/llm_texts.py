"""Texts for the tests."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """A text of ``n`` words that has no word in common with that of another seed."""
    return " ".join(f"{WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % 20]}{seed}n{i * 17 % 97}" for i in range(n))
