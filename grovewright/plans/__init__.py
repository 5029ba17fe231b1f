"""Plan shapes that operators share, adapters over the driver's tables, and the queries."""
