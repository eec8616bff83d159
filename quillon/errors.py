"""Errors of indexing, planning, execution and segments."""

from __future__ import annotations


class SearchError(Exception):
    """Base of all errors of the retrieval engine."""


class IndexError_(SearchError):
    """Base of indexing and execution errors."""


class DuplicateDocument(IndexError_):
    """A document id occurs in more than one row."""


class MissingAnalyzer(IndexError_):
    """A field has no analyzer."""


class MissingScorer(IndexError_):
    """A collector needs scores and no scorer was given."""


class ValueOutOfRange(IndexError_):
    """A count or an id doesn't fit its type."""


class UnsupportedFilterPredicate(IndexError_):
    """A structured filter was executed in strict mode."""


class QueryError(SearchError):
    """Base of query errors."""


class ParseError(QueryError):
    pass


class UnknownField(QueryError):
    pass


class UnknownTerm(QueryError):
    pass


class MaxDepthExceeded(QueryError):
    pass


class MaxNodesExceeded(QueryError):
    pass


class InvalidProgramRoot(QueryError):
    pass


class InvalidProgramReference(QueryError):
    pass


class ProgramCycle(QueryError):
    pass


class UnreachableProgramNode(QueryError):
    pass


class ExtractionError(SearchError):
    """Base of errors of typed views of query nodes."""


class InvalidNodeId(ExtractionError):
    pass


class WrongNodeType(ExtractionError):
    pass


class NonFiniteScore(SearchError, ValueError):
    """A score is NaN or infinite."""


class SegmentError(SearchError):
    """Base of segment validation errors; ``section`` names the section where there is one."""

    def __init__(self, section: object = None):
        super().__init__(type(self).__name__ if section is None else f"{type(self).__name__}({section})")
        self.section = section


class TruncatedHeader(SegmentError):
    pass


class InvalidMagic(SegmentError):
    pass


class UnsupportedVersion(SegmentError):
    pass


class TruncatedDirectory(SegmentError):
    pass


class UnknownSection(SegmentError):
    pass


class DuplicateSection(SegmentError):
    pass


class OutOfBoundsSection(SegmentError):
    pass


class MissingSection(SegmentError):
    pass


class OverlappingSections(SegmentError):
    pass
