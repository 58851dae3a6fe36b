"""deckhand.sources."""
