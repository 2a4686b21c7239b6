"""Expression builders: flags and labels, answer codes, aggregate measures."""
