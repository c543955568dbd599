"""Jobs that put sources and operators together."""
