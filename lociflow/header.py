"""The ordered header lines of a pairs file, and what operators do to them."""

from __future__ import annotations

import shlex

from . import __version__

FORMAT = "## pairs format v1.0.0"


def field(header: list[str], key: str) -> list[str]:
    """Values of all `#key: value` lines, in order."""
    start = f"#{key}:"
    return [x[len(start) :].strip() for x in header if x.startswith(start)]


def columns(header: list[str]) -> list[str] | None:
    got = field(header, "columns")
    return got[-1].split() if got else None


def set_columns(header: list[str], names: list[str]) -> list[str]:
    """Replace the column line, or add one that is missing."""
    line = "#columns: " + " ".join(names)
    out = [line if x.startswith("#columns:") else x for x in header]
    return out if columns(header) is not None else [*out, line]


def chromsizes(header: list[str]) -> dict[str, int]:
    return {n: int(s) for n, s in (x.split()[:2] for x in field(header, "chromsize"))}


def chromosomes(header: list[str]) -> list[str]:
    got = field(header, "chromosomes")
    return got[-1].split() if got else list(chromsizes(header))


def make(names: list[str], sizes: dict[str, int] | None = None, assembly: str | None = None, sam: list[str] | None = None, shape: str = "upper triangle") -> list[str]:
    out = [FORMAT, f"#shape: {shape}", *([f"#genome_assembly: {assembly}"] if assembly else [])]
    out += [f"#samheader: {x}" for x in sam or []]
    if sizes:
        out += ["#chromosomes: " + " ".join(sizes), *(f"#chromsize: {n} {s}" for n, s in sizes.items())]
    return set_columns(out, names)


def add_step(header: list[str], step: str, args: str = "") -> list[str]:
    """Append a program record; ids are made unique, and chained to the record before."""
    ids = [p[3:] for x in field(header, "samheader") if x.startswith("@PG") for p in x.split("\t") if p.startswith("ID:")]
    name, n = f"lociflow_{step}", 1
    while name in ids:
        name, n = f"lociflow_{step}-{n}", n + 1
    parts = ["@PG", f"ID:{name}", "PN:lociflow", *([f"PP:{ids[-1]}"] if ids else []), f"VN:{__version__}", f"CL:{shlex.quote(step)} {args}".rstrip()]
    line, at = "#samheader: " + "\t".join(parts), max((i for i, x in enumerate(header) if x.startswith("#samheader:")), default=None)
    at = next((i for i, x in enumerate(header) if x.startswith("#columns:")), len(header)) if at is None else at + 1
    return [*header[:at], line, *header[at:]]


def mark_sorted(header: list[str]) -> list[str]:
    out = [x for x in header if not x.startswith("#sorted:")]
    return [*out[:1], "#sorted: chr1-chr2-pos1-pos2", *out[1:]]


def subset(header: list[str], chroms: list[str]) -> list[str]:
    keep = set(chroms)
    out = []
    for x in header:
        if x.startswith("#chromosomes:"):
            x = "#chromosomes: " + " ".join(c for c in x.split()[1:] if c in keep)
        elif x.startswith("#chromsize:") and x.split()[1] not in keep:
            continue
        out.append(x)
    return out


def merge(headers: list[list[str]]) -> list[str]:
    """One header of several: equal columns and @SQ lines are demanded, @PG ids made unique."""
    if len({tuple(columns(h) or ()) for h in headers}) > 1 and len({frozenset(columns(h) or ()) for h in headers}) > 1:
        raise ValueError("inputs have different columns")
    lines = lambda h, tag: [x for x in field(h, "samheader") if x.startswith(tag)]
    if len({tuple(lines(h, "@SQ")) for h in headers}) > 1:
        raise ValueError("inputs have different @SQ lines")
    if len(headers) == 1:
        return list(headers[0])
    pgs = []
    for i, h in enumerate(headers):
        for x in lines(h, "@PG"):
            pgs.append("#samheader: " + "\t".join(f"{p}-{i + 1}" if p.startswith(("ID:", "PP:")) else p for p in x.split("\t")))
    rest = [x for x in headers[0] if not x.startswith(("#samheader: @PG", "#sorted:", "#columns:"))]
    last = max((i for i, x in enumerate(rest) if x.startswith("#samheader:")), default=len(rest) - 1) + 1
    return set_columns([*rest[:last], *pgs, *rest[last:]], columns(headers[0]) or [])


def generate(names: list[str], sizes: dict[str, int] | None = None, sam: list[str] | None = None, assembly: str | None = None) -> list[str]:
    """A new header from chromosome sizes, or from a SAM header's @SQ lines."""
    if not sizes and sam:
        sq = [dict(p.split(":", 1) for p in x.split("\t")[1:]) for x in sam if x.startswith("@SQ")]
        sizes = {d["SN"]: int(d["LN"]) for d in sq}
    return make(names, sizes, assembly, sam)


def validate(reference: list[str], names: list[str]) -> None:
    """Raise if the header's columns are not the given ones."""
    if columns(reference) != list(names):
        raise ValueError(f"columns are {columns(reference)}, not {list(names)}")
