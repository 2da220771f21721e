"""A renderer for tests."""


def count(path):
    return 5


def render(path, page, dpi):
    if page == 2:
        raise OSError("broken")
    return bytes(42_000_000) if page == 3 else f"{page}@{dpi}".encode()
