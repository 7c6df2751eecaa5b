"""Languages that a call is about, from the path and the commands it names."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names a language. File extensions, in any case.
EXTENSIONS = {
    "rust": "rs", "typescript": "ts tsx", "javascript": "js jsx", "yaml": "yml yaml", "python": "py", "golang": "go", "bash": "sh bash zsh", "clang": "c h", "clojure": "clj cljs cljc edn",
    "cpp": "cpp cxx cc h hpp hxx", "csharp": "cs csx csproj sln", "dart": "dart", "elixir": "ex exs", "groovy": "groovy gvy gradle", "haskell": "hs lhs cabal", "java": "java", "kotlin": "kt kts",
    "lua": "lua rockspec", "nix": "nix", "objectivec": "m mm", "perl": "pl pm pod", "php": "php", "ruby": "rb", "scala": "scala sc", "swift": "swift", "terraform": "tf tfvars", "zig": "zig zon",
}
# Words of a command line, in any case.
COMMANDS = {
    "rust": "cargo", "typescript": "npm npx yarn bun pnpm", "javascript": "npm npx yarn bun pnpm", "python": "pip python python3", "golang": "go", "bash": "bash sh zsh", "clang": "clang gcc",
    "clojure": "clj clojure lein", "cpp": "clang++ g++", "csharp": "dotnet", "dart": "dart flutter pub", "elixir": "mix iex elixir elixirc", "groovy": "groovy groovyc gradle gradlew",
    "haskell": "ghc ghci cabal stack runghc runhaskell", "java": "java javac mvn gradle gradlew", "kotlin": "kotlin kotlinc gradle gradlew", "lua": "lua luac luarocks",
    "nix": "nix nix-shell nix-build nix-env", "objectivec": "pod xcodebuild clang", "perl": "perl cpan cpanm", "php": "php composer", "ruby": "ruby bundle rake gem", "scala": "scala scalac sbt",
    "swift": "swift xcodebuild", "terraform": "terraform tofu tflint", "zig": "zig",
}
# Whole file names, as written.
MARKERS = {
    "rust": "Cargo.toml Cargo.lock rust-toolchain.toml rust-toolchain", "typescript": "tsconfig.json package.json package-lock.json .node-version .nvmrc yarn.lock pnpm-lock.yaml bun.lockb",
    "javascript": "package.json package-lock.json .node-version .nvmrc yarn.lock pnpm-lock.yaml bun.lockb", "python": "pyproject.toml requirements.txt Pipfile setup.py .python-version Pipfile.lock poetry.lock uv.lock",
    "golang": "go.mod go.sum .go-version go.work", "clang": "CMakeLists.txt", "clojure": "project.clj deps.edn", "cpp": "CMakeLists.txt", "csharp": "global.json nuget.config", "dart": "pubspec.yaml pubspec.lock",
    "elixir": "mix.exs mix.lock", "groovy": "build.gradle settings.gradle", "haskell": "stack.yaml cabal.project", "java": "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts",
    "kotlin": "build.gradle.kts settings.gradle.kts build.gradle settings.gradle", "lua": ".luarc.json", "nix": "flake.nix flake.lock default.nix shell.nix", "objectivec": "Podfile", "perl": "cpanfile Makefile.PL",
    "php": "composer.json composer.lock .php-version", "ruby": "Gemfile Gemfile.lock Rakefile .ruby-version", "scala": "build.sbt", "swift": "Package.swift Podfile", "terraform": "terraform.tfvars .terraform.lock.hcl", "zig": "build.zig build.zig.zon",
}
# Folder names, as written.
FOLDERS = {"typescript": "node_modules", "javascript": "node_modules", "python": "__pycache__ .venv", "objectivec": "Pods", "swift": "Pods", "terraform": ".terraform"}

# Names that differ from the token with a capital.
NAMES = {"typescript": "TypeScript", "javascript": "JavaScript", "yaml": "YAML", "golang": "Go", "bash": "Shell", "clang": "C", "cpp": "C++", "csharp": "C#", "objectivec": "Objective-C", "php": "PHP"}

TOKENS = tuple(EXTENSIONS)


def display_name(token: Column) -> Column:
    """How a language is written; an unknown token as it is."""
    names = {t: NAMES.get(t, t.capitalize()) for t in TOKENS}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), token), token)


def signals(names: dict[str, str]) -> list[tuple[str, str]]:
    """(name, language) pairs of a table."""
    return [(name, token) for token, listed in names.items() for name in listed.split()]


def _lookup(names: dict[str, str], key: Column) -> Column:
    """Languages that a key names; an empty array for none or null."""
    tokens: dict[str, list[str]] = {}
    for name, token in signals(names):
        tokens.setdefault(name, []).append(token)
    table = F.create_map(*[x for name, ts in tokens.items() for x in (F.lit(name), F.array(*map(F.lit, ts)))])
    return F.coalesce(F.try_element_at(table, key), _none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _each(names: dict[str, str], keys: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(keys, lambda k: _lookup(names, k))), _none())


def path_languages(path: Column) -> Column:
    """By the file's whole name, else by its extension, else by any part of the path."""
    base = F.substring_index(path, "/", -1)
    whole = _lookup(MARKERS, base)
    extension = _lookup(EXTENSIONS, F.lower(F.regexp_extract(base, r"(?s).\.([^.]+)$", 1)))
    folders = _each(FOLDERS, F.split(path, "/"))
    return F.coalesce(F.when(F.size(whole) > 0, whole).when(F.size(extension) > 0, extension).otherwise(folders), _none())


def command_languages(text: Column) -> Column:
    """By the whole words of a command line, paths by their last part; variables that are set do not count."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: ~w.rlike("^[A-Z_][A-Z0-9_]*="))
    return _each(COMMANDS, F.transform(words, lambda w: F.lower(F.substring_index(w, "/", -1))))


def infer_languages(tool: Column, path: Column, command: Column, description: Column) -> Column:
    """Languages of a call, each once, as first seen; a command and its description count for the shell tool alone."""
    shell = F.coalesce(tool == "Bash", F.lit(False))
    spoken = [F.when(shell, command_languages(c)).otherwise(_none()) for c in (command, description)]
    return F.array_distinct(reduce(F.concat, [path_languages(path), *spoken]))
