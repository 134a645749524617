"""Extensions to streams: the batch operators of a slice, kept up to date as files arrive."""
