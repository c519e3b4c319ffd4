import pytest

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven grey birds sing near an old river bank under warm summer light".split()


@pytest.fixture(scope="session")
def sf():
    return SF


def prose(seed, n):
    """``n`` words of a fixed pseudo-random order."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 65536 % len(WORDS)] + ("" if x // 4096 % 3 else str(x // 65536 % 97)))
    return " ".join(out)
