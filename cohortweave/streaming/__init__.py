"""No operator of this engine keeps stream state; every analysis is a batch plan."""
