from estatelens.sources.schema import (LISTING_COLUMNS, LISTING_SCHEMA, REQUIRED_FOR_CHANGES,
                                       missing_columns, require_columns)
from estatelens.sources.typed import conform, conform_losses, kind_of, losses_of, probe, require_readable
from estatelens.sources.listings import (jdbc_options, land_listings, listings_from_testdata, read_listings,
                                         read_listings_jdbc, untyped_listings_from_testdata)
from estatelens.sources.text import read_documents, read_pages, read_table

__all__ = [
    "LISTING_COLUMNS", "LISTING_SCHEMA", "REQUIRED_FOR_CHANGES", "missing_columns", "require_columns",
    "conform", "conform_losses", "kind_of", "losses_of", "probe", "require_readable",
    "jdbc_options", "land_listings", "listings_from_testdata", "read_listings", "read_listings_jdbc", "untyped_listings_from_testdata",
    "read_documents", "read_pages", "read_table",
]
