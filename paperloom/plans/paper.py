"""The whole way from lines to pages. Rows that several branches read are written once."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DENSITIES
from ..operators import build, compose, header, language, layout, nodes, segment
from ..operators.cutting import apart, cut


class Paper:
    """Headers, questions with their kinds, and their parts. Each is worked out when it is first asked for and kept, so that a query pays for the parts that it reads and for what these stand on."""

    def __init__(self, segmented: DataFrame, choices: DataFrame | None = None):
        self._segmented, self._choices = segmented, choices

    @cached_property
    def lines(self) -> DataFrame:
        return cut(self._segmented)

    @cached_property
    def wording(self) -> DataFrame:
        return cut(language.wording(self.lines.select("paper_id", "line_no", "flat"), self._choices))

    @cached_property
    def headers(self) -> DataFrame:
        return cut(header.parse_headers(self.lines.where("q_idx = 0")))

    @cached_property
    def _folded(self) -> tuple[DataFrame, DataFrame]:
        return segment.fold_headings(self.lines)

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(nodes.stacked_options(cut(nodes.fold_unnumbered(nodes.raw_nodes(segment.join_wrapped(self._folded[1]))))))

    @cached_property
    def kinds(self) -> DataFrame:
        """Questions before fallbacks and in their own wording."""
        return cut(nodes.question_kinds(self._folded[0], self.nodes))

    @cached_property
    def match(self) -> DataFrame:
        return cut(build.match_rows(self.kinds, self.nodes, self.wording))

    @cached_property
    def listed(self) -> DataFrame:
        return cut(build.items(self.kinds, self.nodes, self.wording))

    @cached_property
    def items(self) -> DataFrame:
        stacked = build.stacked_pairs(self.match).select("paper_id", "q_idx").distinct()
        flat = self.match.join(apart(stacked), ["paper_id", "q_idx"], "left_anti").where("n_split = 0 and not is_header")
        return self.listed.unionByName(flat.select("paper_id", "q_idx", "ord", "label", F.lit(False).alias("lead"), F.col("left").alias("text"), F.lit(False).alias("box")))

    @cached_property
    def questions(self) -> DataFrame:
        # Kinds ask nothing of labels and their order, so items are put in order only where they are read themselves.
        listed = self.listed if "listed" in self.__dict__ else build.item_rows(self.kinds, self.nodes, self.wording)
        return cut(build.reworded_headings(build.settled_kinds(self.kinds, listed, self.match), self.wording))

    @cached_property
    def subs(self) -> DataFrame:
        return cut(build.subs(self.kinds, self.nodes, self.wording))

    @cached_property
    def pairs(self) -> DataFrame:
        return build.pairs(self.match)


def parse(segmented: DataFrame, choices: DataFrame | None = None) -> Paper:
    """Headers, questions with their kinds, and their parts, in the wording that sure suggestions, the user's choice(id, accepted) and the paper's names give. All steps are keyed by paper, or paper and question."""
    return Paper(segmented, choices)


def blocks(paper: Paper, prefix: str = "auto") -> DataFrame:
    """Blocks before any density, numbered within the paper. ``prefix``: what stands before the number of a question."""
    # Items first, as the kinds of questions are told from them where they are at hand.
    items = paper.items
    rows = compose.header_blocks(paper.headers).unionByName(compose.question_blocks(paper.questions, paper.subs, paper.pairs, items, prefix))
    return cut(numbered(rows))


def numbered(rows: DataFrame) -> DataFrame:
    order = ["q_idx", "part", *(["sub"] if "sub" in rows.columns else [])]
    return rows.withColumn("block_no", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order)))


def tall(rows: DataFrame, automatic: bool = True, density: str | None = None) -> DataFrame:
    """Blocks with their heights under every density, or every automatic one, or the one named, on no pages yet. Pages of one density ask nothing of the others."""
    dense = compose.at_densities(layout.measured(rows), automatic)
    return cut(layout.with_heights(dense if density is None else dense.where(F.col("density_id") == density)))


def laid_out(rows: DataFrame, automatic: bool = True, twice: bool = False, density: str | None = None) -> DataFrame:
    """Blocks of ``tall`` on their pages; ``twice``: two copies of the paper to a page."""
    own = tall(rows, automatic, density)
    return layout.paginate(cut(layout.two_up(own)) if twice else own)


def two_up_fitted(rows: DataFrame) -> DataFrame:
    """(paper_id, density_id, pages, height_u, capacity_u, overflow): the loosest automatic density under which two copies of each paper lie on one page, else the tightest, as ``layout.fits`` finds it.

    Whether they do is told by sums. Pages are counted only under the tightest density, for papers that none fits, and no block is copied or cut at any density.
    """
    own = cut(layout.thin(layout.measured(rows)))
    last = max(d[0] for d in DENSITIES if not d[2])
    found = layout.two_up_on_one(layout.with_heights(compose.at_densities(own, automatic=True)))
    facts = ["density_id", "pages", "height_u", "capacity_u"]
    best = cut(found.groupBy("paper_id").agg(F.min(F.when(F.col("pages") == 1, F.struct("rung", *facts))).alias("f")))
    over = best.where("f is null").select("paper_id")
    high = layout.with_heights(compose.at_densities(own.join(apart(over), "paper_id", "left_semi"), automatic=True).where(F.col("rung") == last))
    every = best.where("f is not null").select("paper_id", *[f"f.{c}" for c in facts]).unionByName(layout.two_up_pages(high).select("paper_id", *facts))
    return every.withColumn("overflow", F.col("pages") > 1)


def fitted(rows: DataFrame, max_pages: int = 2) -> DataFrame:
    """(paper_id, density_id, pages, height_u, capacity_u, overflow): the loosest automatic density under which each paper fits, else the tightest, as ``layout.fits`` finds it.

    Densities are tried in order on the papers that are left. Sums of heights settle those that lie on one page and those that cannot fit; only the others are paginated.
    A round is one aggregation by paper and is cut once, so that it is never worked out again and the driver keeps few jobs.
    """
    measured = cut(layout.thin(layout.measured(rows)))
    left, out = None, []
    rungs = [d[0] for d in DENSITIES if not d[2]]
    for rung in rungs:
        own = measured if left is None else measured.join(apart(left), "paper_id", "left_semi")
        high = layout.with_heights(compose.at_densities(own, automatic=True).where(F.col("rung") == rung))
        found = cut(layout.bounded_pages(high, max_pages, every=rung == rungs[-1]))
        out.append(found if rung == rungs[-1] else found.where(F.col("pages") <= max_pages))
        left = found.where(F.coalesce(F.col("pages") > max_pages, F.lit(True))).select("paper_id")
        if rung != rungs[-1] and left.isEmpty():
            break
    every = reduce(DataFrame.unionByName, out)
    return every.select("paper_id", "density_id", "pages", "height_u", "capacity_u", (F.col("pages") > max_pages).alias("overflow"))
