"""Input tables of the jobs: their columns, and a loader that checks them."""

from tripline.sources.schemas import DOCUMENT_COLUMNS, SCHEMAS, conform, load_source

__all__ = ["DOCUMENT_COLUMNS", "SCHEMAS", "conform", "load_source"]
