"""All registered queries; importing a module adds its entries."""

from octroi.catalog import cleaning_queries  # noqa: F401
from octroi.catalog import audit_queries  # noqa: F401
from octroi.catalog import place_queries  # noqa: F401
from octroi.catalog import network_queries  # noqa: F401
from octroi.catalog import route_queries  # noqa: F401
from octroi.catalog import option_queries  # noqa: F401
from octroi.catalog import section_queries  # noqa: F401
from octroi.catalog import table_queries  # noqa: F401
