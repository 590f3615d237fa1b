"""From function rows to all results, each computed when it is first asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking, calibrate, deltas, near_miss, report
from ..operators import cluster as C
from ..operators import profile as P
from ..runtime import cut, stored
from ..schema import Config


class Analysis:
    """One run over function rows. What several results start from (pairs, members, clusters, candidates) is kept in the shared
    folder; everything else is a plan. Rows of different languages (``by_language``) are analysed apart by running one for each."""

    def __init__(self, fns: DataFrame, cfg: Config | None = None) -> None:
        self.cfg = cfg or Config()
        self.source = fns

    @cached_property
    def fns(self) -> DataFrame:
        return stored(self.source)

    @cached_property
    def eligible(self) -> DataFrame:
        return blocking.eligible(self.fns, self.cfg)

    @cached_property
    def postings(self) -> DataFrame:
        return blocking.postings(self.eligible)

    @cached_property
    def shared(self) -> DataFrame:
        return blocking.shared_pairs(self.postings, self.cfg)

    @cached_property
    def candidates(self) -> DataFrame:
        return cut(blocking.candidates(self.eligible, self.cfg))

    @cached_property
    def scored(self) -> DataFrame:
        return blocking.compared(self.candidates, self.eligible, self.cfg)

    def scored_from(self, least: float) -> DataFrame:
        """The scored pairs of which geo may be ``least`` or more: without the edit distances of others, if nothing asked for these yet."""
        return self.__dict__["scored"] if "scored" in self.__dict__ else blocking.compared(self.candidates, self.eligible, self.cfg, least)

    @cached_property
    def edges(self) -> DataFrame:
        return blocking.edges(self.scored_from(self.cfg.identify_threshold), self.cfg)

    @cached_property
    def below(self) -> DataFrame:
        d = blocking.scored_below(self.scored, self.cfg)
        return d.union(blocking.self_scored_below(self.postings, self.eligible, self.cfg)).distinct() if self.cfg.compat else d

    @cached_property
    def groups(self) -> DataFrame:
        return cut(C.link_groups(self.edges, self.fns, self.cfg))

    @cached_property
    def members(self) -> DataFrame:
        return cut(C.kept(self.groups, self.fns, self.fns.agg(F.count("*").alias("n")), self.cfg))

    @cached_property
    def orphans(self) -> DataFrame:
        return C.orphans(self.below, self.groups, self.fns)

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(P.assemble(self.members, self.fns, self.cfg))

    @cached_property
    def near_misses(self) -> DataFrame:
        return cut(near_miss.candidates(self.orphans, self.clusters, self.members, self.fns, self.cfg))

    @cached_property
    def deltas(self) -> DataFrame:
        return deltas.deltas(self.near_misses, self.clusters, self.fns)

    @cached_property
    def avg_scores(self) -> DataFrame:
        return report.average_scores(self.members, self.fns)

    def outliers(self) -> DataFrame:
        return deltas.outliers(self.near_misses, self.clusters, self.fns)

    def export(self, **options) -> DataFrame:
        return deltas.export(self.near_misses, self.clusters, self.members, self.fns, **options)

    def calibrate(self, **options) -> DataFrame:
        return calibrate.calibrate(self.fns, self.cfg, **options)


def by_language(fns: DataFrame, cfg: Config | None = None, languages: tuple[str, ...] = ("golang", "java")) -> dict[str, Analysis]:
    return {x: Analysis(fns.where(F.col("lang") == x), cfg) for x in languages}
