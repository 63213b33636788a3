"""Page-citability analytics expressed as lazy DataFrame transformations."""
