"""Running streams: settings, state, progress."""
