"""Sources: catalog tables, files, JDBC, the seed document, fixtures."""

from sluice.sources.catalog import table_presence
from sluice.sources.documents import ConfigDocumentError, load_config_document, load_fixture
from sluice.sources.jdbc import jdbc_options, parse_extra_options
from sluice.sources.objects import read_files, read_object, read_table

__all__ = ["table_presence", "ConfigDocumentError", "load_config_document", "load_fixture", "jdbc_options",
           "parse_extra_options", "read_files", "read_object", "read_table"]
