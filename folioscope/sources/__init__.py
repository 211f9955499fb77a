"""Sources, the raw reader layer and keyed writes."""
