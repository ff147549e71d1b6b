"""Language packs: fixed tables that drive detection, metrics and rules."""
