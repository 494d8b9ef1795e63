"""Line-by-line Python models, written from the rules and used as a check."""

from __future__ import annotations

FENCE = "'''"
PREFIX = "'''--- "
MARKER = "[Binary file - contents omitted]"
# White space as str.strip sees it, without the four ASCII separators that
# Unicode does not count as white space.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f")


def split_lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [line[:-1] if line.endswith("\r") else line for line in lines]


def squeeze(text: str, limit: int = 2) -> str:
    out, blank = [], 0
    for line in split_lines(text):
        if line.strip(SPACE) == "":
            blank += 1
            if blank <= limit:
                out.append("")
        else:
            blank = 0
            out.append(line)
    return "".join(line + "\n" for line in out)


def blank_runs(text: str) -> list[int]:
    runs, run = [], 0
    for line in [*split_lines(text), "x"]:
        if line.strip(SPACE) == "":
            run += 1
        else:
            runs += [run] if run else []
            run = 0
    return runs


def is_binary(data: bytes) -> bool:
    head = data[:4096]
    bad = sum(b < 32 and b not in (9, 10, 13) for b in head)
    return bool(head) and bad * 100 // len(head) > 10


def text_of(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "Non-UTF8 content"


def frame(path: str, data: bytes) -> str:
    if is_binary(data):
        return f"{PREFIX}{path} ---\n{MARKER}\n"
    return f"{PREFIX}{path} ---\n{text_of(data)}\n{FENCE}\n\n"


def pack(files: list[tuple[str, bytes]]) -> str:
    """The whole bundle is squeezed at the end, in one go."""
    return squeeze("".join(frame(p, d) for p, d in files))


def unpack(text: str) -> list[tuple[str, str]]:
    """(path, file text) per extracted frame; the marker counts on line one."""
    out, path, lines, inside = [], None, [], False
    lines_in = split_lines(text)

    def close():
        if path is not None:
            joined = "\n".join(lines)
            out.append((path, joined if not lines or joined.endswith("\n") else joined + "\n"))

    for line in lines_in:
        if line.startswith(PREFIX):
            close()
            path = line[len(PREFIX) :].rstrip()[: -len(" ---")]
            lines, inside = [], True
        elif line == FENCE and inside:
            inside = False
        elif inside and line == MARKER and not lines:
            path, inside = None, False
        elif inside:
            lines.append(line)
    close()
    return out
