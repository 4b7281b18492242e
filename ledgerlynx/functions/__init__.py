from .exprs import date_rank_key, flag, nz, rnd, rnd_exact, sd, z

__all__ = ["date_rank_key", "flag", "nz", "rnd", "rnd_exact", "sd", "z"]
