"""Prose made up for tests, by rule."""


def prose(rng, n):
    stems = ["ba", "ko", "li", "mer", "tun", "sa", "ve", "dor", "pli", "ran"]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))
