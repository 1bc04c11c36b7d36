"""``python -m tensorloom COMMAND ...``: whole jobs on tensor files.

Inputs are .tns texts (``--start-index`` 1 unless told otherwise); results go to folders of text parts.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tensorloom.operators import elementwise, hicoo, matrix, order, products, reduce, reshape
from tensorloom.plans.cpd import cpd_als
from tensorloom.sources import generate, text
from tensorloom.timing import Timer

PAIRS = {"add": elementwise.add, "sub": elementwise.sub, "dmul": elementwise.dot_mul, "dmul-eq": elementwise.dot_mul_eq, "ddiv": elementwise.dot_div, "kronecker": products.kronecker, "khatri-rao": products.khatri_rao}
SORTS = ("lexi", "best", "worst", "morton", "shuffle")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tensorloom", description=__doc__)
    top.add_argument("--start-index", type=int, default=1)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args, out: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if out:
            p.add_argument("-o", "--output")
        return p

    for name in PAIRS:
        command(name, "x", "y")
    command("status", "x", out=False)
    command("loadstore", "x")
    command("nth", "x", out=False).add_argument("n", type=int)
    command("crop", "x").add_argument("slices", nargs="+")
    command("reindex", "x")
    for name in ("ttm", "sttm", "mttkrp"):
        p = command(name, "x")
        p.add_argument("-m", "--mode", type=int, default=0)
        p.add_argument("-r", "--rank", type=int, default=16)
        p.add_argument("--runs", type=int, default=1)
        p.add_argument("--matrix", help="a text of a matrix, transposed; else a random one")
        p.add_argument("--sort", choices=SORTS, default="lexi")
        p.add_argument("--blocks", type=int, nargs=2, metavar=("SB", "SK"), help="over the blocked format")
        p.add_argument("--renumber", choices=("lexi", "bfs", "mcs", "random"))
    p = command("convert", "x")
    p.add_argument("--blocks", type=int, nargs=2, metavar=("SB", "SK"))
    p.add_argument("-m", "--mode", type=int, default=0)
    p = command("reorder", "x")
    p.add_argument("--how", choices=("lexi", "bfs", "mcs", "random"), default="lexi")
    p.add_argument("--iterations", type=int, default=1)
    p.add_argument("--maps", help="a text with new indices instead")
    p = command("cpd", "x")
    p.add_argument("-r", "--rank", type=int, default=16)
    p.add_argument("-n", "--niters", type=int, default=5)
    p.add_argument("-t", "--tol", type=float, default=1e-5)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--blocks", type=int, nargs=2, metavar=("SB", "SK"))
    p = command("generate", "output", out=False)
    p.add_argument("dims", nargs="+", metavar="[RATE%]DIM", help="with a rate: the share of the mode's indices that is used")
    p = command("diagonal", "output", out=False)
    p.add_argument("dim", type=int)
    return top


def sorted_as(x, how: str, mode: int):
    from tensorloom.functions.keys import best_mode_order, worst_mode_order

    if how == "morton":
        return order.sort_by(x, order.mixed_keys(x, 10))
    if how == "shuffle":
        return order.shuffle_entries(x)
    if how == "lexi":
        return x
    return order.sort_custom(x, (best_mode_order if how == "best" else worst_mode_order)(x.ndims, mode))


def rated(dim: str) -> tuple[float, int]:
    """``50%1024`` as (0.5, 1024); without a rate all indices."""
    rate, sign, size = dim.rpartition("%")
    return (float(rate) / 100 if sign else 1.0), int(size)


def run(spark: SparkSession, argv: list[str]) -> str:
    """Does what ``argv`` says; returns what there is to print."""
    a = parser().parse_args(argv)
    if a.command in ("generate", "diagonal"):
        made = generate.rated_tensor(spark, [rated(d) for d in a.dims]) if a.command == "generate" else generate.diagonal_tensor(spark, a.dim)
        text.write_tns(made, a.output, a.start_index)
        return ""
    x, timer, said = text.read_tns(spark, a.x, a.start_index), Timer(), []
    tensor = None
    if a.command in PAIRS:
        tensor = PAIRS[a.command](x, text.read_tns(spark, a.y, a.start_index))
    elif a.command == "status":
        return reduce.status_report(x)
    elif a.command == "loadstore":
        tensor = x
    elif a.command == "nth":
        return f"{reshape.nth(x, a.n)}\n"
    elif a.command == "crop":
        tensor = reshape.crop(x, a.slices)
    elif a.command == "reindex":
        tensor = reshape.reindex(x)
    elif a.command == "convert":
        if a.blocks:
            h = hicoo.to_hicoo(x, *a.blocks)
            if a.output:
                text.hicoo_lines(h).orderBy("part", "at").select("line").write.text(a.output)
            return "\n".join(f"{k}: {v}" for k, v in hicoo.status(h).first().asDict().items()) + "\n"
        tensor = reshape.from_semisparse(reshape.to_semisparse(x, a.mode))
    elif a.command == "reorder":
        tensor = reshape.relabel(x, text.read_maps(spark, a.maps, x.ndims) if a.maps else order.renumber(x, a.how, a.iterations))
    elif a.command == "cpd":
        k = cpd_als(hicoo.to_hicoo(x, *a.blocks) if a.blocks else x, a.rank, a.niters, a.tol, a.seed)
        for m, f in enumerate(k.factors if a.output else []):
            text.write_matrix(f, f"{a.output}/mode{m}", x.ndims[m], a.rank)
        return f"fit: {k.fit:.6f}\nlambda: {' '.join(f'{v:.6g}' for v in k.lam)}\n"
    else:
        if a.renumber:
            x = reshape.relabel(x, order.renumber(x, a.renumber))
        x = sorted_as(x, a.sort, a.mode)
        if a.command == "mttkrp":
            us = [matrix.randomize(spark, d, a.rank, k) for k, d in enumerate(x.ndims)]
            h = hicoo.to_hicoo(x, *a.blocks) if a.blocks else None
            for _ in range(a.runs):
                with timer:
                    out = hicoo.hicoo_mttkrp(h, us, a.mode, a.rank) if h else products.mttkrp(x, us, a.mode, a.rank)
                    out.write.format("noop").mode("overwrite").save()
            if a.output:
                text.write_matrix(out, a.output, x.ndims[a.mode], a.rank)
        else:
            u, rows, cols = text.read_matrix_transposed(spark, a.matrix) if a.matrix else (matrix.randomize(spark, x.ndims[a.mode], a.rank), x.ndims[a.mode], a.rank)
            for _ in range(a.runs):
                with timer:
                    y = products.ttm(x, u, a.mode, rows, cols) if a.command == "ttm" else products.sttm(reshape.to_semisparse(x, a.mode), u, a.mode, rows, cols)
                    y.df.write.format("noop").mode("overwrite").save()
            tensor = reshape.from_semisparse(y)
        said.append(timer.average(a.command))
    if tensor is not None and a.output:
        text.write_tns(tensor, a.output, a.start_index)
    return "\n".join([*said, ""]) if said else ""


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("tensorloom").getOrCreate(), sys.argv[1:]), end="")
