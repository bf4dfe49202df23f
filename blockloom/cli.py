"""The command: compresses or decompresses files, block by block on all cores.

    python -m blockloom.cli [-z | -d | -t] [-c] [-k] [-f] [-q] [-v] [-s] [-n N] [-1 ... -9] [FILE ...]

Exit code: 0, 1 for trouble with files or arguments, 2 for damaged data; of several files the worst. Called by a name with
`unzip` in it, it decompresses; with `zcat` or `z2cat`, to the standard output.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from concurrent.futures import ProcessPoolExecutor
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path

from .functions import block, runs, stream

#: Suffixes of packed files and what replaces them.
SUFFIXES = {".bz2": "", ".bz": "", ".tbz2": ".tar", ".tbz": ".tar"}


def arguments(argv: list[str], program: str = "") -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="blockloom")
    mode = {"dest": "mode", "action": "store_const"}
    p.add_argument("-z", "--compress", const="z", **mode)
    p.add_argument("-d", "--decompress", const="d", **mode)
    p.add_argument("-t", "--test", const="t", **mode)
    for short, long in (("-c", "--stdout"), ("-k", "--keep"), ("-f", "--force"), ("-q", "--quiet"), ("-v", "--verbose"), ("-s", "--small")):
        p.add_argument(short, long, action="store_true")
    p.add_argument("-n", "--threads", type=int, default=os.cpu_count())
    for n in range(1, 10):
        p.add_argument(f"-{n}", *(["--fast"] if n == 1 else ["--best"] if n == 9 else []), dest="level", action="store_const", const=n)
    p.add_argument("-V", "--version", action="version", version="blockloom")
    p.add_argument("files", nargs="*")
    base = os.path.basename(program).lower()
    cat = "zcat" in base or "z2cat" in base
    p.set_defaults(mode="d" if cat or "unzip" in base else "z", level=9, stdout=cat)
    return p.parse_args(argv)


def unpacked_name(name: str) -> tuple[str, bool]:
    """The name without its suffix, and whether there was a known one."""
    for suffix, instead in SUFFIXES.items():
        if name.endswith(suffix) and os.path.basename(name) != suffix:
            return name.removesuffix(suffix) + instead, True
    return name + ".out", False


def decimal(value: Decimal, digits: int) -> str:
    return str(value.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def summary(before: int, after: int) -> str:
    if not before or not after:
        return " no data compressed."
    a, b = Decimal(before), Decimal(after)
    saved = decimal(100 * (a - b) / a, 2)
    return f"{decimal(a / b, 3):>6}:1, {decimal(8 * b / a, 3):>6} bits/byte, {saved:>5}% saved, {before} in, {after} out."


def packed(data: bytes, level: int, workers: int) -> bytes:
    """The same bytes for any number of workers."""
    parts = [data[a:b] for a, b, _ in runs.cuts(data, level)]
    if workers > 1 and len(parts) > 1:
        with ProcessPoolExecutor(workers) as pool:
            done = list(pool.map(block.encode_chunk, parts, [level] * len(parts)))
    else:
        done = [block.encode_chunk(p, level) for p in parts]
    return block.assembled(done, level)


def unpacked(data: bytes, workers: int) -> stream.Decoded:
    if workers == 1:
        return stream.decompress(data)
    with ProcessPoolExecutor(workers) as pool:
        return stream.decompress_on(pool, data)


def one(name: str, o: argparse.Namespace, column: int = 0) -> int:
    say = lambda text: print(f"{name}: {text}", file=sys.stderr)
    tell = lambda text: print(f"  {name}: {'':{max(0, column - len(name))}}{text}", file=sys.stderr)
    workers = 1 if o.small else max(1, o.threads)
    to_stdout = o.stdout or name == "-"
    try:
        if name != "-":
            path = Path(name)
            if path.is_dir() or not path.exists() or not path.is_file():
                say("is a directory." if path.is_dir() else "no such file.")
                return 1
            if path.is_symlink() and not (o.force or to_stdout):
                say("is a link.")
                return 1
        if o.mode == "z" and name != "-":
            known = next((s for s in SUFFIXES if name.endswith(s) and os.path.basename(name) != s), None)
            if known:
                say(f"already has suffix {known}.")
                return 1
        if name == "-" and o.mode != "z" and sys.stdin.isatty() or o.mode == "z" and to_stdout and sys.stdout.isatty():
            say("a terminal holds no packed data.")
            return 1
        data = sys.stdin.buffer.read() if name == "-" else Path(name).read_bytes()
        if o.mode == "z":
            out = packed(data, o.level, workers)
            if o.verbose:
                tell(summary(len(data), len(out)))
            target = name + ".bz2"
        else:
            got = unpacked(data, workers)
            if got.error:
                say(f"damaged: {got.error}")
                return 2
            if got.trailing and not o.quiet:
                say("trailing garbage ignored.")
            if o.mode == "t":
                if o.verbose:
                    tell("ok")
                return 0
            out = got.raw
            target, known = unpacked_name(name)
            if not known and not to_stdout and not o.quiet:
                say(f"no known suffix, writing {target}.")
        if to_stdout:
            sys.stdout.buffer.write(out)
            sys.stdout.buffer.flush()
            return 0
        if os.path.exists(target) and not o.force:
            say(f"{target} is there already.")
            return 1
        if o.force and os.path.lexists(target):
            os.unlink(target)
        handle = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(out)
            own = os.stat(name)
            try:
                os.chown(target, own.st_uid, own.st_gid)
            except OSError:
                pass  # only the superuser may give files away
            shutil.copystat(name, target)
        except BaseException:
            os.unlink(target)
            raise
        if not o.keep:
            os.unlink(name)
        return 0
    except BrokenPipeError:
        return 0
    except OSError as e:
        say(e.strerror or str(e))
        return 1


def main(argv: list[str] | None = None, program: str | None = None) -> int:
    try:
        o = arguments(sys.argv[1:] if argv is None else argv, sys.argv[0] if program is None else program)
    except SystemExit as e:
        return 1 if e.code else 0
    names = o.files or ["-"]
    return max([one(name, o, max(map(len, names))) for name in names])


if __name__ == "__main__":
    sys.exit(main())
