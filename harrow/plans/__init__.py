"""Job plans: the full mining job and the queries over the driver tables."""
