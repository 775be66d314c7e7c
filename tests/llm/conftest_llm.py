def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
