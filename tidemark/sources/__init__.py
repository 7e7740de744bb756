"""Sources and sinks: files of feeds, replay packs, books, and result writers."""
