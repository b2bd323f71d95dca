"""A panel-analytics engine of DataFrame transformations."""
