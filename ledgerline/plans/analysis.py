"""group -> correlate -> reconstruct -> reconcile over all cases at once."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import finding
from ..operators import history, identity, provenance, reconcile, transactions
from ..sources.tables import settle
from .change_log import Case


class Analysis:
    """The stages of an analysis. Each is worked out when it is first asked for, from the stages that it needs, and written where
    more than one reads it."""

    def __init__(self, case: Case):
        self._case = case

    @cached_property
    def _keyed(self) -> DataFrame:
        return identity.keyed_events(self._case.events, self._case.catalog).drop("columns")

    @cached_property
    def grouping(self) -> transactions.Grouping:
        return transactions.group(self._keyed, self._case.markers, self._case.log_files)

    @cached_property
    def gaps(self) -> DataFrame:
        return settle(transactions.coverage_gaps(self._case.log_files, self._case.markers))

    @cached_property
    def coverage(self) -> DataFrame:
        return transactions.coverage(self._case.catalog, self.gaps)

    @cached_property
    def correlation(self) -> identity.Correlation:
        return identity.correlate(self.grouping, self._case.snapshot, self._case.catalog)

    @cached_property
    def history(self) -> history.History:
        return history.reconstruct(self.correlation.record_events, self.correlation.record_images, self._case.catalog, self.gaps)

    @cached_property
    def reconciliation(self) -> reconcile.Reconciliation:
        c = self._case
        return reconcile.reconcile(self.correlation, self.history, c.catalog, c.health, c.extractions, c.creations, self.coverage)

    @property
    def field_verdicts(self) -> DataFrame:
        return self.reconciliation.field_verdicts

    @property
    def record_verdicts(self) -> DataFrame:
        return self.reconciliation.record_verdicts

    @property
    def explanations(self) -> DataFrame:
        return self.reconciliation.explanations

    @cached_property
    def findings(self) -> DataFrame:
        """(case_id, rule_id, subject, context) of every stage."""
        c, found = self._case, self.correlation
        unbacked = finding(self.coverage.filter("not complete"), "R-COV-005", F.col("case_id"))
        parts = [self.grouping.findings, transactions.coverage_findings(c.log_files, c.markers), found.findings, history.history_findings(found.record_images, self.history, c.catalog, self.gaps, found.aliases), unbacked]
        if c.runs is not None:
            parts.append(provenance.missing_runs(self.grouping.events, c.runs))
        return reduce(DataFrame.unionByName, parts)


def analyse(case: Case) -> Analysis:
    return Analysis(case)
