"""Text for the tests."""

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine".split()


def prose(seed, n):
    """n words that repeat late."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % 16] + WORDS[(x >> 20) % 16][:2] + chr(97 + (x >> 24) % 26))
    return " ".join(out)
