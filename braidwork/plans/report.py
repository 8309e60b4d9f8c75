"""Recorded runs as markdown tables, spliced into a text between markers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from ..operators.blocking import Refused


def render(header: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """An aligned table; columns of numbers are set to the right."""
    table = [list(map(str, header)), *[list(map(str, r)) for r in rows]]
    if any(len(r) != len(header) for r in table):
        raise Refused("a row has another number of cells than the header")
    widths = [max(3, *(len(r[i]) for r in table)) for i in range(len(header))]
    numeric = [i > 0 and all(c[:1].isdigit() or c[:1] in "+-" for c in (r[i] for r in table[1:])) for i in range(len(header))]
    line = lambda r: "| " + " | ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, widths, numeric)) + " |"
    rule = "| " + " | ".join("-" * (w - 1) + (":" if n else "-") for w, n in zip(widths, numeric)) + " |"
    return "\n".join([line(table[0]), rule, *map(line, table[1:])])


def figure(value: float | None, digits: int = 3) -> str:
    return "-" if value is None else f"{value:.{digits}f}"


def band(low: float, median: float, high: float) -> str:
    return f"{median:.3f} [{low:.3f}, {high:.3f}]"


def ratio(part: int, whole: int) -> str:
    """Nothing to divide by is shown as nothing, not as 0 or 1."""
    return "-" if not whole else f"{part} of {whole}"


def policy_table(bands: dict[str, tuple[float, float, float]], shipped: str) -> str:
    """Policies by their bands; refuses when the shipped one isn't the best."""
    best = max(bands, key=lambda n: bands[n][1])
    if best != shipped:
        raise Refused(f"{best} beats the shipped {shipped}")
    return render(["policy", "F1, median [range]"], [[n, band(*b)] for n, b in bands.items()])


def head_to_head_table(rows: Sequence[tuple[str, str, int, int, int, float]]) -> str:
    return render(["policy", "against", "wins", "losses", "ties", "p"], [[*r[:5], figure(r[5])] for r in rows])


def closure_table(merges: dict[str, tuple[int, int]]) -> str:
    return render(["policy", "merges", "correct"], [[n, m, "-" if not m else c] for n, (m, c) in merges.items()])


def ablation_table(f1: dict[str, float], reference: str = "all") -> str:
    """Differences are taken before rounding; there is exactly one reference row."""
    if reference not in f1:
        raise Refused(f"no reference row {reference!r}")
    rows = sorted(f1.items(), key=lambda p: (-p[1], p[0]))
    return render(["features", "F1", "delta"], [[n, figure(v), "reference" if n == reference else f"{v - f1[reference]:+.3f}"] for n, v in rows])


def blocking_table(rows: Sequence[tuple[str, int, float | None, float]]) -> str:
    return render(["blocking", "pairs", "recall", "reduction"], [[n, p, figure(r), figure(d, 4)] for n, p, r, d in rows])


def classifier_table(rows: Sequence[tuple[str, float, float | None, float]]) -> str:
    return render(["configuration", "precision", "recall", "F1"], [[n, figure(p), figure(r), figure(f)] for n, p, r, f in rows])


def bold(text: str, when: bool) -> str:
    return f"**{text}**" if when else text


def volume_table(rows: Sequence[tuple[str, float, float | None, float, int]], shipped: str) -> str:
    """Ways to use volume numbers; the shipped one's F1 is bold."""
    body = [[n, figure(p), figure(r), bold(figure(f), n == shipped), fp] for n, p, r, f, fp in rows]
    return render(["configuration", "precision", "recall", "F1", "false positives"], body)


def layers_table(single: dict[str, tuple[float, int]], one: dict[str, tuple[float, int]], splits: int, features: int, reference: str = "all") -> str:
    """Feature groups over many splits: mean F1 and wins against the reference, for single pairs and one-to-one.

    The reference row is named by its number of features and wins against nothing; there has to be just one.
    """
    if list(single) != list(one) or list(single).count(reference) != 1:
        raise Refused(f"both layers need the same groups and one reference {reference!r}")
    wins = lambda name, n: "-" if name == reference else f"{n}/{splits}"
    body = [
        [f"all {features} features" if n == reference else n, figure(single[n][0]), wins(n, single[n][1]), figure(one[n][0]), wins(n, one[n][1])]
        for n in single
    ]
    return render(["feature set", "pair F1", "beats all", "one-to-one F1", "beats all"], body)


def model_table(rows: Sequence[tuple[str, float, float | None, float]], shipped: str) -> str:
    """Configurations of the model; the shipped one is bold, and refused if another one is better."""
    top = max(r[3] for r in rows)
    if next(r[3] for r in rows if r[0] == shipped) < top - 1e-12:
        raise Refused(f"{shipped!r} has not the best F1, {top:.4f}")
    return render(["model", "precision", "recall", "F1"], [[n, figure(p), figure(r), bold(figure(f), n == shipped)] for n, p, r, f in rows])


def opposite_table(rows: Sequence[tuple[str, float, float, float, float]]) -> str:
    """Configurations whose best F1 and best end-to-end recall are in different rows, both bold.

    Refuses when one row has both, or when a maximum is shared: the text around the table says otherwise.
    """
    best = []
    for column, name in ((3, "F1"), (4, "end-to-end recall")):
        values = [r[column] for r in rows]
        if values.count(max(values)) != 1:
            raise Refused(f"several rows share the best {name}")
        best.append(values.index(max(values)))
    if best[0] == best[1]:
        raise Refused(f"{rows[best[0]][0]!r} has both the best F1 and the best end-to-end recall")
    body = [[n, figure(p), figure(r), bold(figure(f), i == best[0]), bold(figure(e), i == best[1])] for i, (n, p, r, f, e) in enumerate(rows)]
    return render(["configuration", "precision", "recall", "F1", "end-to-end recall"], body)


def search_space_table(rows: Sequence[tuple[str, float, int, float]]) -> str:
    """Every blocking that was measured, none of them marked."""
    return render(["method", "recall", "pairs kept", "% of search space"], [[n, figure(r), f"{k:,}", f"{s:.2%}"] for n, r, k, s in rows])


#: Where each table goes: its builder and what its header has to hold where a text has no markers yet.
BLOCKS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "blocking": (blocking_table, ("blocking", "reduction")),
    "ablation": (ablation_table, ("features", "delta")),
    "policies": (policy_table, ("policy", "median")),
    "head-to-head": (head_to_head_table, ("against", "wins")),
    "closure": (closure_table, ("merges", "correct")),
    "volumes": (volume_table, ("configuration", "false positives")),
    "layers": (layers_table, ("feature set", "one-to-one F1")),
    "model": (model_table, ("model", "precision")),
    "opposite": (opposite_table, ("configuration", "end-to-end recall")),
    "search-space": (search_space_table, ("method", "% of search space")),
}


def built(runs: dict[str, dict]) -> dict[str, str]:
    """The tables of recorded runs, each given as the arguments of its builder; refuses a name that has none."""
    if unknown := sorted(set(runs) - set(BLOCKS)):
        raise Refused(f"no tables {unknown}; there are {sorted(BLOCKS)}")
    return {name: BLOCKS[name][0](**arguments) for name, arguments in runs.items()}


def splice(text: str, blocks: dict[str, str]) -> str:
    """Replaces what stands between ``<!-- name -->`` and ``<!-- /name -->``; each marker has to occur once.

    In a text without these markers the table with the only fitting header is replaced, and marked.
    """
    for name, block in blocks.items():
        start, end = f"<!-- {name} -->", f"<!-- /{name} -->"
        if start not in text and end not in text and name in BLOCKS:
            text = _marked(text, name)
        if text.count(start) != 1 or text.count(end) != 1 or text.index(start) > text.index(end):
            raise Refused(f"the text has no single place for {name}")
        head, rest = text.split(start)
        text = head + start + "\n" + block + "\n" + end + rest.split(end)[1]
    return text


def _marked(text: str, name: str) -> str:
    """The text with markers around the table whose header holds all that ``BLOCKS`` names."""
    lines = text.split("\n")
    heads = [i for i, x in enumerate(lines) if x.startswith("|") and (i == 0 or not lines[i - 1].startswith("|")) and all(w in x for w in BLOCKS[name][1])]
    if len(heads) != 1:
        raise Refused(f"{len(heads)} tables could be {name}")
    last = heads[0]
    while last < len(lines) and lines[last].startswith("|"):
        last += 1
    return "\n".join([*lines[: heads[0]], f"<!-- {name} -->", *lines[heads[0] : last], f"<!-- /{name} -->", *lines[last:]])
