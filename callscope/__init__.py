"""callscope: Spark jobs for call-chain analytics over fleets of code bases."""
