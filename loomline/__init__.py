"""Entity resolution, survivorship and two-clock history as Spark plans."""
