"""Parameters of the enrichment pipeline."""

from __future__ import annotations

from dataclasses import dataclass

# Places in a nested file whose fields have other names here.
PLACES = {
    "selected_model.summarizer": "summarizer", "selected_model.embedding.name": "encoder", "selected_model.embedding.embedding_dim": "embedding_dim",
    "models.summarizers.name": "summarizers", "models.embeddings.name": "encoders",
}
#: Fields of listed models that are for readers only.
_NOTES = {"models.summarizers.description", "models.embeddings.description", "models.embeddings.embedding_dim"}


@dataclass(frozen=True)
class Config:
    # The defaults of the pipeline.
    document_limit: int = 50
    timeout: int = 10000
    max_requests_per_crawl: int = 25000
    embed_batch_size: int = 16
    chunk_sentence_limit: int = 100
    max_tokens: int = 512
    batch_size: int = 32
    embedding_dim: int = 64
    encoder: str = "hashed-64"
    summarizer: str = "hashed-64"
    #: The models on offer.
    encoders: tuple[str, ...] = ()
    summarizers: tuple[str, ...] = ()

    @classmethod
    def read(cls, path: str) -> Config:
        """From a file of ``name: value`` lines, nested by indentation, with lists of models; unknown names are an
        error, '#' begins a comment."""
        values: dict = {}
        above: list[tuple[int, str]] = []
        with open(path, encoding="utf-8") as file:
            for line in file:
                line = line.split("#")[0].rstrip()
                bare = line.lstrip(" -")
                if not bare:
                    continue
                indent = len(line) - len(bare)
                while above and above[-1][0] >= indent:
                    above.pop()
                name, _, value = (x.strip() for x in bare.partition(":"))
                place = ".".join([*(n for _, n in above), name])
                if not value:
                    above.append((indent, name))
                elif place not in _NOTES:
                    name, value = PLACES.get(place, place), value.strip("'\"")
                    kind = cls.__dataclass_fields__[name].type
                    values[name] = int(value) if kind == "int" else (*values.get(name, ()), value) if kind.startswith("tuple") else value
        return cls(**values)
