"""Names of output files from names of input files."""

from __future__ import annotations


def without_extension(path: str) -> str:
    """Up to the last dot of the file's name; a name without a dot, or that only begins with one, stays."""
    at = path.rfind(".")
    return path[:at] if at > path.rfind("/") + 1 else path


def stem(path: str) -> str:
    """The file's name without its folder and extension."""
    return without_extension(path).rpartition("/")[2]


def diff_outputs(out: str, in1: str, in2: str) -> tuple[str, str, str]:
    """Where the differing records go, and those that only one input has: the inputs' names go before the extension."""
    base = without_extension(out)
    return out, *(f"{base}_only{i}_{stem(x)}{out[len(base):]}" for i, x in ((1, in1), (2, in2)))


def fastq_outputs(in_file: str, out_base: str | None = None, gzip: bool = False) -> dict[str, str]:
    """Files of first, second and unpaired reads; the base is the input without its extension unless given."""
    base, end = out_base or without_extension(in_file), ".fastq" + (".gz" if gzip else "")
    return {"first": f"{base}_1{end}", "second": f"{base}_2{end}", "unpaired": f"{base}{end}"}
