"""newsloom: article intelligence as Spark jobs.

Tables of raw web pages go in; a clean, enriched, searchable table of articles comes out. Every stage is a
DataFrame -> DataFrame function, so Catalyst sees one plan from the page scan to the sink.
"""

__version__ = "0.1.0"
