"""deckhand.plans."""
